"""Registered queries in whose input every branch of a rule occurs: audit findings, event limits, all multipliers,
brand bands, double filings, keys, question routes.

What the driver tables do not carry (venues, event costs, filings in parts, questions in words) is stand-in input
made by rules that the builders' docstrings state; the jobs see rows of the schema alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.functions import exact, keys
from fundlake.functions.exact import ratio, ratio_sql
from fundlake.operators import corpus, rules, windows
from fundlake.plans import metrics
from fundlake.plans.catalog import _FR_JOIN, _LATEST, FY, REGION_FULL
from fundlake.plans.catalog_proof import _FILED_SQL, filed_claims
from fundlake.plans.catalog_rules import PRIOR_FY, _m
from fundlake.plans.catalog_text import _CHAT_SQL, _CORPUS_SQL, _pick, _rx, _sql_pick, chat_turns, corpus_rows
from fundlake.plans.model import Model
from fundlake.plans.oracle import q
from fundlake.session import checkpoint_root
from fundlake.sources import files
from fundlake.sources.domain import ACTIVITY_CATEGORIES

REGISTRY: dict = {}
M = exact.money
# The initiative's own fund (O7): claims on programs that end so are its participants'.
INITIATIVE_PROGRAM = "-LAB"
BEFORE_FY = "FY99"  # the year before PRIOR_FY
# A snapshot 44 days before the fiscal year's end, for questions about the next 60 days.
LATE_AS_OF, SOON_DAYS = "2002-01-15", 60
CLAIMS_A_TASK = 500_000  # claims that one task joins, multiplies and groups


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _number(col: str = "claim_id") -> F.Column:
    return F.regexp_extract(F.col(col), "[0-9]+", 0).cast("bigint")


def _by(values: dict, col: str, cast: str) -> F.Column:
    e = None
    for k, v in values.items():
        e = F.when(F.col(col) == k, F.lit(v)) if e is None else e.when(F.col(col) == k, F.lit(v))
    return e.cast(cast)


# ------------------------------------------------------------------- audit
def audited_claims(m) -> DataFrame:
    """Stand-in for claims with a venue: every ninth claim is executed elsewhere; a dealer whose number is divisible
    by 25 files each claim in 24 parts on up to seven days.

    A claim is few bytes until it is joined, so shuffled claims sized by bytes were millions in one task, which then
    made, grouped and sorted their parts.  They are dealt by number, and what groups by dealer needs no further exchange."""
    c = m.silver.coop_claim.select("claim_id", "dealer_id", "fiscal_year", "submission_date", "preapproval_id")
    n = max(int(m.spark.conf.get("spark.sql.shuffle.partitions")), -(-c.count() // CLAIMS_A_TASK))
    c = c.repartition(n, "dealer_id")
    c = c.join(m.dealer_flat.select("dealer_id", "region"), "dealer_id", "left")
    parts = F.when(_number("dealer_id") % 25 == 0, F.sequence(F.lit(0), F.lit(23))).otherwise(F.array(F.lit(0)))
    x = c.withColumn("part", F.explode(parts))
    venue = F.when(_number() % 9 == 0, F.lit("ELSEWHERE")).otherwise(F.col("region"))
    return x.select(F.concat_ws("-", "claim_id", F.col("part").cast("string")).alias("claim_id"), "dealer_id", "fiscal_year",
                    F.date_add("submission_date", F.col("part") % 7).alias("submission_date"), "preapproval_id", "region", venue.alias("venue_region"))


_AUDITED_SQL = """audited AS (
  SELECT c.claim_id || '-' || p.i AS claim_id, c.dealer_id, c.fiscal_year, c.submission_date + CAST(p.i % 7 AS INTEGER) AS submission_date,
         c.preapproval_id, r.region, CAST(substr(c.claim_id, 4) AS BIGINT) % 9 = 0 AS elsewhere
  FROM s_claim c JOIN range(0, 24) p(i) ON p.i = 0 OR CAST(substr(c.dealer_id, 3) AS BIGINT) % 25 = 0
  LEFT JOIN s_dealer d ON c.dealer_id = d.dealer_id LEFT JOIN dim_region r ON d.region_id = r.region_id)"""


@register("rule_audit_findings", q("""
SELECT 'late_cycle_dumping' AS flag_type, dealer_id || ' ' || fiscal_year AS subject,
       count_if(month(submission_date) = 1 AND day(submission_date) >= 25) AS n
FROM audited GROUP BY dealer_id, fiscal_year HAVING count_if(month(submission_date) = 1 AND day(submission_date) >= 25) > 0.3 * count(*)
UNION ALL
SELECT 'preapproval_expired_reuse', c.claim_id, c.submission_date - s.f FROM audited c JOIN (
  SELECT preapproval_id, min(submission_date) AS f FROM audited WHERE preapproval_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) s
  ON c.preapproval_id = s.preapproval_id WHERE c.submission_date - s.f > 90
UNION ALL
SELECT 'claim_density', dealer_id, max(n7) FROM (
  SELECT a.dealer_id, a.d, CAST(sum(b.n) AS BIGINT) AS n7 FROM (SELECT DISTINCT dealer_id, submission_date AS d FROM audited) a
  JOIN (SELECT dealer_id, submission_date AS d, count(*) AS n FROM audited GROUP BY 1, 2) b ON a.dealer_id = b.dealer_id AND b.d BETWEEN a.d - 6 AND a.d
  GROUP BY 1, 2) x GROUP BY dealer_id HAVING max(n7) > 20
UNION ALL
SELECT 'out_of_region', claim_id, 1 FROM audited WHERE elsewhere AND region IS NOT NULL""", _AUDITED_SQL))
def rule_audit_findings(spark, sf_dir):
    """Every finding of the four audit triggers (late-cycle dumping, use of an expired pre-approval, more than 20
    claims in a week, a venue outside the dealer's region) over the stand-in of ``audited_claims``."""
    return rules.audit_findings(audited_claims(_m(spark, sf_dir)))


# ------------------------------------------------------------------ events
def costed_events(m) -> DataFrame:
    """Marketing events with a cost, a stand-in: 60 to 259 USD an attendee by the event's number, and up to 49 USD more."""
    k = _number("event_id")
    cost = F.col("attendees").cast("decimal(10,0)") * (F.lit(60) + k % 200).cast("decimal(4,0)") + (k % 50).cast("decimal(4,0)")
    return m.silver.marketing_event.select("event_id", "dealer_id", "activity_type_id", "attendees", cost.cast("decimal(12,2)").alias("event_cost_usd")) \
        .join(m.dealer_flat.select("dealer_id", "region"), "dealer_id", "left")


@register("rule_event_limits", q(f"""
SELECT event_id, attendees, event_cost_usd, {ratio_sql('event_cost_usd', 'attendees', 2, 1, 'duckdb')} AS per_head_usd,
       activity_type_id IN ('ACT-07', 'ACT-08', 'ACT-10') AND attendees < 10 AS too_few,
       coalesce(activity_type_id = 'ACT-10' AND region = 'AMERICA' AND event_cost_usd > 185 * attendees, false) AS over_cap
FROM (SELECT 'EV-' || e.event_id AS event_id, 'ACT-' || lpad(CAST(e.event_id % 22 AS VARCHAR), 2, '0') AS activity_type_id, r.region,
             CAST(trunc(e.value) AS INTEGER) AS attendees,
             CAST(CAST(trunc(e.value) AS BIGINT) * (60 + e.event_id % 200) + e.event_id % 50 AS DECIMAL(12,2)) AS event_cost_usd
      FROM events e LEFT JOIN s_dealer d ON d.dealer_id = 'D-' || printf('%06d', e.user_id)
      LEFT JOIN dim_region r ON d.region_id = r.region_id) x"""))
def rule_event_limits(spark, sf_dir):
    """Attendees and spend per attendee of every event, with too few attendees (events that need ten) and
    hospitality above the cap per attendee flagged."""
    x = rules.event_checks(costed_events(_m(spark, sf_dir)))
    return x.select("event_id", "attendees", "event_cost_usd", ratio("event_cost_usd", "attendees", 2).alias("per_head_usd"), "too_few", "over_cap")


# -------------------------------------------------------------- allocation
@register("rule_allocation_four_multipliers", q(f"""
SELECT dealer_id, tier, reached_target, on_brand, first_pass, initiative, CAST(mult AS DECIMAL(6,4)) AS multiplier,
       CAST(CAST((CASE tier WHEN 'Platinum' THEN 200000 WHEN 'Gold' THEN 80000 WHEN 'Silver' THEN 25000 ELSE 8000 END)
            + rev * (CASE tier WHEN 'Platinum' THEN CAST(0.015 AS DECIMAL(4,3)) WHEN 'Gold' THEN CAST(0.010 AS DECIMAL(4,3))
                               WHEN 'Silver' THEN CAST(0.005 AS DECIMAL(4,3)) ELSE CAST(0 AS DECIMAL(4,3)) END) AS DECIMAL(24,5)) * mult
            AS DECIMAL(14,2)) AS allocation_usd
FROM (SELECT *, least(CAST(1.25 AS DECIMAL(9,8)), CAST(
        (CASE WHEN reached_target THEN CAST(1.10 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
        * (CASE WHEN on_brand THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
        * (CASE WHEN first_pass THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
        * (CASE WHEN initiative THEN CAST(1.10 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END) AS DECIMAL(9,8))) AS mult
  FROM (SELECT d.dealer_id, d.tier, coalesce(o.rev, 0) AS rev, coalesce(o.rev, 0) > 0 AND coalesce(o.rev, 0) >= coalesce(o.rev2, 0) AS reached_target,
               coalesce(s.n > 0 AND s.ssum >= 85 * s.n, false) AS on_brand, coalesce(4 * s.n_fp >= 3 * s.n_all, false) AS first_pass,
               coalesce(s.n_lab > 0, false) AS initiative
        FROM s_dealer d
        LEFT JOIN (SELECT dealer_id, sum(CASE WHEN fiscal_year = '{PRIOR_FY}' THEN net_revenue_usd END) AS rev,
                          sum(CASE WHEN fiscal_year = '{BEFORE_FY}' THEN net_revenue_usd END) AS rev2
                   FROM s_order WHERE fiscal_year IN ('{PRIOR_FY}', '{BEFORE_FY}') GROUP BY 1) o ON d.dealer_id = o.dealer_id
        LEFT JOIN (SELECT dealer_id, count(brand_compliance_score) AS n, sum(brand_compliance_score) AS ssum, count(*) AS n_all,
                          count_if(status IN ('Approved', 'Paid') AND brand_compliance_score >= 70) AS n_fp,
                          count_if(program_id LIKE '%{INITIATIVE_PROGRAM}') AS n_lab
                   FROM s_claim WHERE fiscal_year = '{PRIOR_FY}' GROUP BY 1) s ON d.dealer_id = s.dealer_id) a) b"""))
def rule_allocation_four_multipliers(spark, sf_dir):
    """Next year's allocation with all four multipliers (sell-in at least the year before's, brand score of 85,
    first-pass share of 75 %, a claim on the initiative's program, for which the Lab fund stands), capped at 1.25.
    Orders and claims are read once each."""
    m = _m(spark, sf_dir)
    o = m.silver.sell_through_order.where(F.col("fiscal_year").isin(PRIOR_FY, BEFORE_FY))

    def revenue(fy):
        return F.sum(F.when(F.col("fiscal_year") == fy, F.col("net_revenue_usd")))
    o = o.groupBy("dealer_id").agg(revenue(PRIOR_FY).alias("rev"), revenue(BEFORE_FY).alias("rev2"))
    score = F.col("brand_compliance_score")
    s = m.silver.coop_claim.where(F.col("fiscal_year") == PRIOR_FY).groupBy("dealer_id").agg(
        F.count(score).alias("n"), F.sum(score).alias("ssum"), F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("status").isin("Approved", "Paid") & (score >= 70)).alias("n_fp"),
        F.count_if(F.col("program_id").endswith(INITIATIVE_PROGRAM)).alias("n_lab"))
    zero = F.lit(0).cast("decimal(14,2)")

    def sure(c):
        return F.coalesce(c, F.lit(False))
    rev, rev2 = F.coalesce("rev", zero), F.coalesce("rev2", zero)
    d = m.dim_dealer.select("dealer_id", "tier").join(o, "dealer_id", "left").join(s, "dealer_id", "left").select(
        "dealer_id", "tier", rev.alias("rev"), sure((rev > 0) & (rev >= rev2)).alias("reached_target"),
        sure((F.col("n") > 0) & (F.col("ssum") >= F.col("n") * 85)).alias("on_brand"),
        sure(F.col("n_fp") * 4 >= F.col("n_all") * 3).alias("first_pass"), sure(F.col("n_lab") > 0).alias("initiative"))
    mult = rules.performance_multiplier([(F.col("reached_target"), rules.MULT_TARGET), (F.col("on_brand"), rules.MULT_BRAND),
                                         (F.col("first_pass"), rules.MULT_FIRST_PASS), (F.col("initiative"), rules.MULT_NETZERO)])
    base = (_by(rules.TIER_BASE, "tier", "decimal(8,0)") + F.col("rev") * _by(rules.TIER_SELL_IN_PCT, "tier", "decimal(4,3)")).cast("decimal(18,5)")
    return d.select("dealer_id", "tier", "reached_target", "on_brand", "first_pass", "initiative",
                    mult.cast("decimal(6,4)").alias("multiplier"), (base * mult).cast("decimal(14,2)").alias("allocation_usd"))


# ---------------------------------------------------------------- brand bands
def scored_claims(m) -> DataFrame:
    """Claims with points by brand dimension as JSON, a stand-in: 45 to 100 % of a dimension's points by the claim's
    number, up to six points of a hundred apart between dimensions."""
    k = _number()
    pts = [F.floor(F.lit(p) * F.least(F.lit(100), F.lit(45) + k % 56 + (k * i) % 7) / 100).cast("int").alias(n)
           for i, (n, p) in enumerate(rules.BRAND_DIMENSIONS)]
    return m.silver.coop_claim.select("claim_id", F.to_json(F.struct(*pts)).alias("brand_check_json"))


_PTS = ", ".join(f"{p} * least(100, 45 + k % 56 + (k * {i}) % 7) // 100 AS p{i}" for i, (_, p) in enumerate(rules.BRAND_DIMENSIONS))
_WEAK = " OR ".join(f"p{i} * 2 < {p}" for i, (_, p) in enumerate(rules.BRAND_DIMENSIONS))


@register("rule_brand_bands_by_points", q(f"""
SELECT CASE WHEN s >= 85 THEN 'Approved' WHEN s >= 70 THEN 'Approved with notes' WHEN s >= 50 THEN 'Remediation required' ELSE 'Auto-rejected' END AS brand_band,
       s < total AS capped, count(*) AS n_claims
FROM (SELECT p0 + p1 + p2 + p3 + p4 AS total, CASE WHEN {_WEAK} THEN least(p0 + p1 + p2 + p3 + p4, 49) ELSE p0 + p1 + p2 + p3 + p4 END AS s
      FROM (SELECT {_PTS} FROM (SELECT CAST(substr(claim_id, 4) AS BIGINT) AS k FROM s_claim) a) b) c GROUP BY 1, 2"""))
def rule_brand_bands_by_points(spark, sf_dir):
    """Claims by brand band from the points of the five dimensions, and whether a weak dimension capped the score."""
    x = scored_claims(_m(spark, sf_dir))
    total = sum((F.get_json_object("brand_check_json", f"$.{n}").cast("int") for n, _ in rules.BRAND_DIMENSIONS[1:]),
                F.get_json_object("brand_check_json", f"$.{rules.BRAND_DIMENSIONS[0][0]}").cast("int"))
    b = x.select(rules.brand_band(F.col("brand_check_json")).alias("b"), total.alias("total"))
    return b.groupBy("b.brand_band", (F.col("b.brand_score") < F.col("total")).alias("capped")).agg(F.count(F.lit(1)).alias("n_claims"))


# -------------------------------------------------------- double filings (G11), program years
@register("double_dips_filed", q("""
SELECT f.claim_id, f.program_id, row_number() OVER (PARTITION BY f.dealer_id, f.activity_type_id, f.submission_date ORDER BY f.claim_id) > 1 AS is_duplicate
FROM filed f JOIN dips g ON f.dealer_id = g.dealer_id AND f.activity_type_id = g.activity_type_id AND f.submission_date = g.submission_date
WHERE g.n_programs > 1""", _FILED_SQL))
def double_dips_filed(spark, sf_dir):
    """Claims of one dealer, activity and day on two programs among the filed ones (``filed_claims``); the
    earliest stays, later ones are flagged."""
    c = filed_claims(_m(spark, sf_dir)).select("claim_id", "dealer_id", "activity_type_id", "submission_date", "program_id")
    r = windows.duplicates_across(c, ["dealer_id", "activity_type_id", "submission_date"], "program_id", [F.col("submission_date"), F.col("claim_id")])
    return r.select("claim_id", "program_id", "is_duplicate")


@register("quality_program_years_filed", q("""
SELECT program_id, count(DISTINCT fiscal_year) AS n_fiscal_years, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM (
  SELECT CASE WHEN CAST(substr(claim_id, 4) AS BIGINT) % 41 = 0
              THEN 'PRG-' || (year(submission_date) - CASE WHEN month(submission_date) < 3 THEN 2 ELSE 1 END) || '-MAIN' ELSE program_id END AS program_id,
         fiscal_year FROM s_claim) x
GROUP BY 1 HAVING count(DISTINCT fiscal_year) > 1"""))
def quality_program_years_filed(spark, sf_dir):
    """D9-style guard: programs with claims of several fiscal years, in a stand-in feed where every 41st claim is filed
    on the year before's main program."""
    from fundlake.functions import fiscal
    c = _m(spark, sf_dir).silver.coop_claim
    late = F.concat(F.lit("PRG-"), (fiscal.fiscal_year_num("submission_date") - 1).cast("string"), F.lit("-MAIN"))
    c = c.select(F.when(_number() % 41 == 0, late).otherwise(F.col("program_id")).alias("program_id"), "fiscal_year")
    return c.groupBy("program_id").agg(F.countDistinct("fiscal_year").alias("n_fiscal_years"), F.min("fiscal_year").alias("first_year"),
                                       F.max("fiscal_year").alias("last_year")).where("n_fiscal_years > 1")


# --------------------------------------------------------------------- keys
_CODES = ["DIG", "EVT", "SHO", "CON", "SPO"]  # of ACTIVITY_CATEGORIES, by activity % 5


@register("claims_by_key_parts", q("""
SELECT r.region, CAST(r.n_nationkey AS VARCHAR) AS sub_region, c.fiscal_year, a.category, count(*) AS n_claims,
       CAST(sum(c.requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd
FROM s_claim c JOIN s_dealer d ON c.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
JOIN activity_type a ON c.activity_type_id = a.activity_type_id GROUP BY ALL"""))
def claims_by_key_parts(spark, sf_dir):
    """Claims by region, sub-region, fiscal year and category read from their keys alone, no dimension joined but
    the dealer for its region key; activity keys with the category's code (``ACT-DIG-05``) are a stand-in."""
    m = _m(spark, sf_dir)
    a = F.right("activity_type_id", F.lit(2)).cast("int")
    code = _pick(_CODES, a % len(ACTIVITY_CATEGORIES))
    c = m.silver.coop_claim.select("dealer_id", "program_id", "requested_amount_usd",
                                   F.concat_ws("-", F.lit("ACT"), code, F.right("activity_type_id", F.lit(2))).alias("activity_key"))
    j = c.join(m.dim_dealer.select("dealer_id", "region_id"), "dealer_id")
    parts = [keys.region_of(F.col("region_id")).alias("region"), keys.sub_region_of(F.col("region_id")).alias("sub_region"),
             keys.program_fiscal_year(F.col("program_id")).alias("fiscal_year"), keys.activity_category(F.col("activity_key")).alias("category")]
    return j.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_claims"), M(F.sum("requested_amount_usd")).alias("requested_usd"))


# --------------------------------------------------- questions
QUESTIONS = ["How many dealers have unused funds?", "Show the lift of each campaign by region.", "Is signage allowed under the policy?",
             "What do dealers in Europe get paid?", "Please look at this:"]


def asked_questions(spark, sf_dir) -> DataFrame:
    """User turns that open with a question in words, a stand-in: by (conversation + turn) one of five openings."""
    t = chat_turns(spark, sf_dir).where("role = 'user'")
    opening = _pick(QUESTIONS, (F.col("session_id") + F.col("turn_index")) % len(QUESTIONS))
    return t.withColumn("text", F.concat_ws(" ", opening, "text"))


def _routes_sql() -> str:
    text = f"concat_ws(' ', {_sql_pick(QUESTIONS, f'(session_id + turn_index) % {len(QUESTIONS)}')}, text)"
    return _CHAT_SQL + f""",
asked AS (SELECT session_id, turn_index, user_role, {text} AS text FROM chat WHERE role = 'user'),
routes AS (
  SELECT session_id, turn_index, user_role,
         CASE WHEN user_role = 'channel_mgr' AND {_rx('text', corpus.REFUSE_OTHER_REGION)} THEN 'refuse'
              WHEN {_rx('text', corpus.QUANT_VERBS)} THEN CASE WHEN {_rx('text', corpus.MARKETING_SIGNALS)} THEN 'metrics_marketing' ELSE 'metrics_utilization' END
              ELSE 'ka' END AS route FROM asked)"""


def _routes(spark, sf_dir) -> DataFrame:
    return asked_questions(spark, sf_dir).select("session_id", "turn_index", "user_role", corpus.route(F.col("text"), F.col("user_role")).alias("route"))


@register("question_routes_in_words", "WITH " + _routes_sql() + "\nSELECT * FROM routes")
def question_routes_in_words(spark, sf_dir):
    """The route of every question of ``asked_questions``; all four routes occur, refusal by role too."""
    return _routes(spark, sf_dir)


@register("chat_latency_by_route", "WITH " + _routes_sql() + """
SELECT r.route, count(*) AS n_questions, count(a.latency_ms) AS n_answers,
       CAST(quantile_cont(a.latency_ms, 0.5) AS DECIMAL(12,2)) AS p50_ms, CAST(quantile_cont(a.latency_ms, 0.95) AS DECIMAL(12,2)) AS p95_ms
FROM routes r LEFT JOIN chat a ON a.session_id = r.session_id AND a.turn_index = r.turn_index + 1 AND a.role = 'assistant' GROUP BY 1""")
def chat_latency_by_route(spark, sf_dir):
    """Latency percentiles of the answers (the next assistant turn) by the route of the question."""
    a = chat_turns(spark, sf_dir).where("role = 'assistant'").select("session_id", (F.col("turn_index") - 1).alias("turn_index"), "latency_ms")
    j = _routes(spark, sf_dir).join(a, ["session_id", "turn_index"], "left")
    return j.groupBy("route").agg(F.count(F.lit(1)).alias("n_questions"), F.count("latency_ms").alias("n_answers"),
                                  F.percentile("latency_ms", 0.5).cast("decimal(12,2)").alias("p50_ms"),
                                  F.percentile("latency_ms", 0.95).cast("decimal(12,2)").alias("p95_ms"))


@register("eval_figures_in_range", "WITH " + _CHAT_SQL + r"""
SELECT session_id, turn_index, len(n) AS n_numbers,
       coalesce(list_bool_or(list_transform(n, lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE) BETWEEN 1 AND 100)), false) AS has_number_in_range
FROM (SELECT session_id, turn_index, regexp_extract_all(text || ' The share is ' || (session_id * 7 + turn_index) % 250 || '.5 of 12,000 dealers.',
                                                        '[0-9][0-9,]*\.?[0-9]*') AS n FROM chat WHERE role = 'assistant') x""")
def eval_figures_in_range(spark, sf_dir):
    """The numbers of each answer and whether one lies in [1, 100]; answers close with a share by conversation
    and turn (0.5 to 249.5), a stand-in."""
    share = (F.col("session_id") * 7 + F.col("turn_index")) % 250
    text = F.concat(F.col("text"), F.lit(" The share is "), share.cast("string"), F.lit(".5 of 12,000 dealers."))
    t = chat_turns(spark, sf_dir).where("role = 'assistant'").select("session_id", "turn_index", text.alias("answer"))
    return t.select("session_id", "turn_index", F.size(F.regexp_extract_all("answer", F.lit(f"({corpus.NUMBER})"), 1)).cast("bigint").alias("n_numbers"),
                    F.coalesce(corpus.numbers_in_range(F.col("answer"), 1, 100), F.lit(False)).alias("has_number_in_range"))


# --------------------------------------------------------------- questions Q6, F9
@register("q_expiring_dealers_60_days", q(f"""
SELECT d.dealer_name, d.tier, CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd, min(u.days_to_expiration) AS days_to_expiration
FROM {_FR_JOIN} WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}' AND u.days_to_expiration BETWEEN 0 AND {SOON_DAYS}
GROUP BY d.dealer_name, d.tier""", as_of=LATE_AS_OF))
def q_expiring_dealers_60_days(spark, sf_dir):
    """Q6 as asked: dealers whose funds expire within 60 days, at a snapshot 44 days before the year's end."""
    r = metrics.query(Model(spark, sf_dir, as_of=LATE_AS_OF), "forfeiture_risk", ["dealer_name", "tier"], ["unused_usd_total", "days_to_expiration"],
                      where=[("fiscal_year", FY), ("region_full", REGION_FULL), ("days_to_expiration_dim", "between", (0, SOON_DAYS))])
    return r.select("dealer_name", "tier", M(F.round("unused_usd_total", 0), 0).alias("unused_usd"), "days_to_expiration")


@register("q_average_lift_by_tier", q("""
SELECT tier, CAST(avg(lift_vs_control_pct) AS DECIMAL(8,4)) AS lift_vs_control_pct, CAST(sum(attributed_coop_usd_lift) AS DECIMAL(18,2)) AS lift_usd
FROM perf GROUP BY 1"""))
def q_average_lift_by_tier(spark, sf_dir):
    """the unweighted average lift against control of the dealer months of each tier."""
    r = metrics.query(_m(spark, sf_dir), "dealer_performance", ["tier"], ["lift_vs_control_pct", "attributed_coop_usd_lift"])
    return r.select("tier", F.col("lift_vs_control_pct").cast("decimal(8,4)").alias("lift_vs_control_pct"), M("attributed_coop_usd_lift").alias("lift_usd"))


# ------------------------------------------------------- markdown files
FRONT_MATTER = {"doc_id": "bigint", "title": "string", "audience": "string", "region": "string", "effective_date": "date", "expires": "date", "version": "string"}
FOLDER_FILES = 1000


def markdown_files(spark, sf_dir) -> str:
    """A folder with a markdown file a document, a stand-in: front matter by rule (no version where the id is divisible
    by 10), then the whole text, which opens with a line that looks like a field where it is divisible by 4."""
    c = corpus_rows(spark, sf_dir)
    k = F.col("doc_id")
    line = [F.lit("---"), F.concat(F.lit("title: Policy "), F.col("family_id"), F.lit(": part "), (k % 9).cast("string")),
            F.concat(F.lit("doc_id: "), k.cast("string")), F.concat(F.lit("audience: "), F.col("audience")), F.concat(F.lit("region: "), F.col("region")),
            F.concat(F.lit("effective_date: "), F.col("effective_date").cast("string")), F.concat(F.lit("expires: "), F.col("expires").cast("string")),
            F.when(k % 10 != 0, F.concat(F.lit("version: FY0"), (k % 7).cast("string"), F.lit("."), (k % 4 + 1).cast("string"))), F.lit("---"),
            F.when(k % 4 == 0, F.lit("version: none")), F.coalesce("text", F.lit(""))]
    path = checkpoint_root(spark, "markdown")
    # a file a row, in folders that one task each fills
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-c.count() // FOLDER_FILES))
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("folder")
    texts = c.select("doc_id", F.concat_ws("\n", *line).alias("value"), folder).repartition(n, "folder").groupBy("folder", "doc_id") \
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value"))  # an id that stands twice is one file
    files.write_texts(texts.withColumn("name", F.concat(F.lit("doc"), F.coalesce(k.cast("string"), F.lit("")))), path)
    return path


@register("corpus_markdown_files", "WITH " + _CORPUS_SQL + """
SELECT doc_id, 'Policy ' || family_id || ': part ' || (doc_id % 9) AS title, audience, region, effective_date, expires,
       CASE WHEN doc_id % 10 <> 0 THEN 'FY0' || (doc_id % 7) || '.' || (doc_id % 4 + 1) END AS version,
       md5(CASE WHEN doc_id % 4 = 0 THEN 'version: none' || chr(10) ELSE '' END || coalesce(text, '') || chr(10)) AS body_md5
FROM corpus""")
def corpus_markdown_files(spark, sf_dir):
    """Markdown files read whole, front matter as typed columns (dates, version), the body kept to the byte."""
    x = corpus.markdown_columns(files.read_markdown(spark, markdown_files(spark, sf_dir)), FRONT_MATTER)
    return x.select(*FRONT_MATTER, F.md5("body").alias("body_md5"))
