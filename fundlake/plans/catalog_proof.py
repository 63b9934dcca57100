"""Registered queries over proof files, due dates, id-list hashes, daily grids, grouping sets and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.functions import exact, fiscal
from fundlake.operators import proof, rules, windows, workflow
from fundlake.plans.catalog_more import LIST_IDS, _lists
from fundlake.plans.catalog_ops import _BURN_SQL
from fundlake.plans.catalog_rules import (_BD_SQL, _GAP_SQL, _RULES_SQL, AS_OF, CAMPAIGN_OWNER, CAMPAIGN_TEMPLATE,
                                          _claims_with_dealer, _m)
from fundlake.plans.catalog_text import _CHAT_SQL, chat_turns
from fundlake.plans.oracle import q

REGISTRY: dict = {}
M = exact.money
# The documents that the stand-in for uploaded files knows, in its own order.
FILE_KINDS = sorted({d for _, docs in proof.PROOF_DOCUMENTS for d in docs})


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------- proof
def _number() -> F.Column:
    return F.substring("claim_id", 4, 32).cast("bigint")


def proof_files(m) -> DataFrame:
    """(claim_id, document, uploaded_on): stand-in for the uploads; of every kind a claim has a file
    unless (claim number + kind number) is divisible by 31."""
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(FILE_KINDS)])
    x = m.silver.coop_claim.select("claim_id", "submission_date", _number().alias("k"), F.explode(kinds).alias("f"))
    return x.where((F.col("k") + F.col("f.i")) % 31 != 0).select(
        "claim_id", F.col("f.d").alias("document"),
        F.date_add("submission_date", ((F.col("k") * 3 + F.col("f.i")) % 20).cast("int")).alias("uploaded_on"))


_NEEDED = ", ".join(f"('ACT-{a:02d}', '{d}')" for acts, docs in proof.PROOF_DOCUMENTS for a in acts for d in docs)
_KINDS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(FILE_KINDS))
_PROOF_SQL = f"""needed(activity_type_id, document) AS (VALUES {_NEEDED}),
kinds(i, document) AS (VALUES {_KINDS}),
files AS (
  SELECT c.claim_id, f.document, c.submission_date + CAST((CAST(substr(c.claim_id, 4) AS BIGINT) * 3 + f.i) % 20 AS INTEGER) AS uploaded_on
  FROM s_claim c CROSS JOIN kinds f WHERE (CAST(substr(c.claim_id, 4) AS BIGINT) + f.i) % 31 <> 0),
proof AS (
  SELECT c.claim_id, count(n.document) AS n_required, count_if(n.document IS NOT NULL AND f.document IS NULL) AS n_missing,
    coalesce(string_agg(n.document, ',' ORDER BY n.document) FILTER (WHERE f.document IS NULL), '') AS missing
  FROM s_claim c LEFT JOIN needed n ON c.activity_type_id = n.activity_type_id
  LEFT JOIN files f ON f.claim_id = c.claim_id AND f.document = n.document GROUP BY c.claim_id)"""


@register("rule_proof_completeness", q("SELECT claim_id, n_required, n_missing, missing FROM proof", _PROOF_SQL))
def rule_proof_completeness(spark, sf_dir):
    """Required, missing and listed missing documents of every claim."""
    m = _m(spark, sf_dir)
    return proof.completeness(m.silver.coop_claim, proof.requirements(spark), proof_files(m))


def filed_claims(m) -> DataFrame:
    """Claims as they were filed, a stand-in: every 13th a second time for another program; with the region of
    the venue (every ninth elsewhere) and the points by brand dimension (the logo of every eleventh weak);
    every seventh names no pre-approval."""
    k = _number()
    c = _claims_with_dealer(m).withColumn("k", k).withColumn("preapproval_id", F.when(F.col("k") % 7 != 0, F.col("preapproval_id")))
    again = c.where("k % 13 = 0").withColumn("claim_id", F.concat("claim_id", F.lit("-B"))).withColumn("program_id", F.concat("program_id", F.lit("-B")))
    points = F.struct(*[(F.when(F.col("k") % 11 == 0, F.lit(5)).otherwise(F.lit(p)) if name == "logo" else F.lit(p)).alias(name)
                        for name, p in rules.BRAND_DIMENSIONS])
    return c.unionByName(again).withColumn("venue_region", F.when(F.col("k") % 9 == 0, F.lit("ELSEWHERE")).otherwise(F.col("region"))) \
        .withColumn("brand_check_json", F.to_json(points))


_FILED_SQL = """filed AS (
  SELECT claim_id, claim_id AS base_id, dealer_id, activity_type_id, submission_date, program_id FROM s_claim
  UNION ALL SELECT claim_id || '-B', claim_id, dealer_id, activity_type_id, submission_date, program_id || '-B' FROM s_claim
  WHERE CAST(substr(claim_id, 4) AS BIGINT) % 13 = 0),
dips AS (
  SELECT dealer_id, activity_type_id, submission_date, count(DISTINCT program_id) AS n_programs FROM filed GROUP BY 1, 2, 3)"""


@register("rule_rejection_reasons", q("""
SELECT code, count(*) AS n_claims FROM (
  SELECT CASE WHEN a.requires_preapproval AND e.requested_amount_usd >= a.preapproval_threshold_usd AND (e.preapproval_id IS NULL OR CAST(substr(e.claim_id, 4) AS BIGINT) % 7 = 0)
              THEN 'MISSING_PREAPPROVAL'
              WHEN NOT coalesce(e.eligible, false) THEN 'TIER_INELIGIBLE'
              WHEN CAST(substr(e.claim_id, 4) AS BIGINT) % 11 = 0 THEN 'OFF_BRAND'
              WHEN e.region IS NOT NULL AND CAST(substr(e.claim_id, 4) AS BIGINT) % 9 = 0 THEN 'OUT_OF_REGION'
              WHEN p.n_missing > 0 THEN 'DOC_INCOMPLETE'
              WHEN g.n_programs > 1 THEN 'DOUBLE_DIP' ELSE 'OTHER' END AS code
  FROM filed f JOIN elig e ON f.base_id = e.claim_id LEFT JOIN activity_type a ON e.activity_type_id = a.activity_type_id
  LEFT JOIN proof p ON p.claim_id = f.base_id
  LEFT JOIN dips g ON e.dealer_id = g.dealer_id AND e.activity_type_id = g.activity_type_id AND e.submission_date = g.submission_date
  WHERE e.status = 'Rejected') x GROUP BY code""", _RULES_SQL + ",\n" + _PROOF_SQL + ",\n" + _FILED_SQL))
def rule_rejection_reasons(spark, sf_dir):
    """Rejection code of every rejected claim with all seven branches: brand score from the points by
    dimension, venue outside the dealer's region, missing proof documents, filed for two programs.  The joined sides
    have about a row a claim, so they are never broadcast."""
    m = _m(spark, sf_dir)
    filed = rules.eligibility(filed_claims(m), rules.activity_rules(spark))
    a = F.broadcast(m.silver.activity_type.select("activity_type_id", "requires_preapproval", "preapproval_threshold_usd"))
    same = ["dealer_id", "activity_type_id", "submission_date"]
    dips = filed_claims(m).groupBy(*same).agg(F.countDistinct("program_id").alias("n_programs"))
    papers = proof.completeness(m.silver.coop_claim, proof.requirements(spark), proof_files(m)).select(F.col("claim_id").alias("base_id"), "n_missing")
    j = (filed.where("status = 'Rejected'").withColumn("base_id", F.regexp_replace("claim_id", "-B$", ""))
         .join(a, "activity_type_id", "left").join(papers.hint("merge"), "base_id", "left").join(dips.hint("merge"), same, "left"))

    def sure(c):
        return F.coalesce(c, F.lit(False))
    missing = F.col("requires_preapproval") & (F.col("requested_amount_usd") >= F.col("preapproval_threshold_usd")) & F.col("preapproval_id").isNull()
    code = rules.rejection_code(sure(missing), ~sure(F.col("eligible")), rules.brand_band(F.col("brand_check_json"))["brand_score"],
                                sure(F.col("venue_region") != F.col("region")), sure(F.col("n_missing") > 0), sure(F.col("n_programs") > 1))
    return j.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_claims"))


# ------------------------------------------------------------------ due dates
@register("rule_due_dates", q(f"""
SELECT c.claim_id, i1.date AS brand_due, i2.date AS cmm_due, i3.date AS finance_due,
  coalesce(c.decision_date > i2.date, false) AS decided_late, coalesce(c.payment_date > i3.date, false) AS paid_late,
  coalesce(u.last_upload > make_date(year(c.submission_date) + CASE WHEN month(c.submission_date) < 3 THEN 0 ELSE 1 END, 2, 14), false) AS proof_late
FROM s_claim c LEFT JOIN bd b1 ON c.submission_date = b1.date_key LEFT JOIN days i1 ON i1.ordinal = b1.bd_index + 3
LEFT JOIN days i2 ON i2.ordinal = b1.bd_index + 8
LEFT JOIN bd b3 ON c.decision_date = b3.date_key LEFT JOIN days i3 ON i3.ordinal = b3.bd_index + 10
LEFT JOIN (SELECT claim_id, max(uploaded_on) AS last_upload FROM files GROUP BY 1) u ON u.claim_id = c.claim_id""",
                              _BD_SQL + ",\ndays AS (SELECT bd_index AS ordinal, min(date_key) AS date FROM bd GROUP BY 1),\n" + _PROOF_SQL))
def rule_due_dates(spark, sf_dir):
    """A claim's due dates (brand review 3 business days after submission, CMM review 5 after that,
    finance 10 after the decision), and whether decision, payment or the last proof file (Feb 14 of the
    fiscal year's end) came late."""
    m = _m(spark, sf_dir)
    idx = fiscal.business_day_index(m.silver.fiscal_calendar_from_data())
    c = m.silver.coop_claim.select("claim_id", "submission_date", "decision_date", "payment_date")
    c = rules.after_business_days(c, idx, "submission_date", rules.SLA_BRAND_BD, "brand_due")
    c = rules.after_business_days(c, idx, "brand_due", rules.SLA_CMM_BD, "cmm_due")
    c = rules.after_business_days(c, idx, "decision_date", rules.SLA_FINANCE_BD, "finance_due")
    last = proof_files(m).groupBy("claim_id").agg(F.max("uploaded_on").alias("last_upload"))
    deadline = F.make_date(fiscal.fiscal_year_num("submission_date") + 1, F.lit(rules.DEADLINE_PROOF[0]), F.lit(rules.DEADLINE_PROOF[1]))

    def sure(c_):
        return F.coalesce(c_, F.lit(False))
    return c.join(last, "claim_id", "left").select(
        "claim_id", "brand_due", "cmm_due", "finance_due", sure(F.col("decision_date") > F.col("cmm_due")).alias("decided_late"),
        sure(F.col("payment_date") > F.col("finance_due")).alias("paid_late"), sure(F.col("last_upload") > deadline).alias("proof_late"))


# ----------------------------------------------------------------- id lists
@register("campaign_hashes", q(f"""
SELECT region_id, CAST(sum(n) AS BIGINT) AS recipient_count,
  sha256('{CAMPAIGN_OWNER}' || '|' || sha256(string_agg(h, ',' ORDER BY part)) || '|{CAMPAIGN_TEMPLATE}|{AS_OF}') AS call_hash
FROM (SELECT region_id, custkey // {LIST_IDS} AS part, count(*) AS n, sha256(string_agg(dealer_id, ',' ORDER BY dealer_id)) AS h
      FROM gap GROUP BY 1, 2) x GROUP BY region_id""", _GAP_SQL))
def campaign_hashes(spark, sf_dir):
    """The call hash of each region's campaign over its sorted recipients, through a hash of each
    list of at most 1,000 ids."""
    h = workflow.list_hash(_lists(_m(spark, sf_dir)), "region_id")
    call = F.sha2(F.concat_ws("|", F.lit(CAMPAIGN_OWNER), "ids_hash", F.lit(CAMPAIGN_TEMPLATE), F.lit(AS_OF)), 256)
    return h.select("region_id", F.col("n_ids").alias("recipient_count"), call.alias("call_hash"))


# ---------------------------------------------------------------------- grid
_GRID_SQL = """daily AS (SELECT dealer_id, program_id, day, sum(committed_usd) AS c, sum(paid_usd) AS p FROM burn_events GROUP BY 1, 2, 3),
spine AS (
  SELECT dealer_id, program_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM daily GROUP BY 1, 2),
grid AS (
  SELECT s.dealer_id, s.program_id, s.day, d.day IS NOT NULL AS active, sum(coalesce(d.c, 0)) OVER w AS cum_c, sum(coalesce(d.p, 0)) OVER w AS cum_p
  FROM spine s LEFT JOIN daily d ON s.dealer_id = d.dealer_id AND s.program_id = d.program_id AND s.day = d.day
  WINDOW w AS (PARTITION BY s.dealer_id, s.program_id ORDER BY s.day ROWS UNBOUNDED PRECEDING))"""


@register("burn_down_grid", q("""
SELECT program_id, day, count(*) AS n_dealers, CAST(sum(cum_c) AS DECIMAL(18,2)) AS committed_usd, CAST(sum(cum_p) AS DECIMAL(18,2)) AS paid_usd
FROM grid GROUP BY 1, 2""", _BURN_SQL + ",\n" + _GRID_SQL))
def burn_down_grid(spark, sf_dir):
    """the trend line of each program: per day the dealers in their span and their cumulative committed and
    paid amounts, from the full grid of dealer, program and day with values carried forward."""
    c = _m(spark, sf_dir).silver.coop_claim
    zero = F.lit(0).cast("decimal(12,2)")
    ev = c.where(F.col("status").isin("Submitted", "Under_Review", "Approved", "Paid")).select(
        "dealer_id", "program_id", F.col("submission_date").alias("day"), F.col("requested_amount_usd").alias("committed_usd"), zero.alias("paid_usd"))
    ev = ev.unionByName(c.where("status = 'Paid'").select("dealer_id", "program_id", F.col("payment_date").alias("day"),
                                                          zero.alias("committed_usd"), F.col("paid_amount_usd").alias("paid_usd")))
    g = windows.daily_grid(ev, ["dealer_id", "program_id"], "day", ["committed_usd", "paid_usd"])
    return g.groupBy("program_id", "day").agg(F.count(F.lit(1)).alias("n_dealers"), M(F.sum("cum_committed_usd")).alias("committed_usd"),
                                              M(F.sum("cum_paid_usd")).alias("paid_usd"))


# ------------------------------------------------------------------ grouping sets (F16)
@register("forfeiture_grouping_sets", q("""
SELECT r.region, r.sub_region, u.program_id, CAST(sum(u.unused_usd) AS DECIMAL(18,2)) AS unused_usd,
       CAST(grouping(r.region, r.sub_region, u.program_id) AS INTEGER) AS grouping_id
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
GROUP BY GROUPING SETS ((r.region), (r.region, r.sub_region), (r.region, u.program_id), ())"""))
def forfeiture_grouping_sets(spark, sf_dir):
    """F16: unused balance by region, by region and sub-region, by region and program, and in all, in one pass."""
    m = _m(spark, sf_dir)
    j = m.utilization.join(m.dealer_flat.select("dealer_id", "region", "sub_region"), "dealer_id")
    dims = ["region", "sub_region", "program_id"]
    return windows.grouped_sets(j, [["region"], ["region", "sub_region"], ["region", "program_id"], []], dims, [M(F.sum("unused_usd")).alias("unused_usd")])


# --------------------------------------------------------------------- compaction
@register("chat_compaction", "WITH " + _CHAT_SQL + """,
numbered AS (SELECT user_id, length(text) AS n_chars, row_number() OVER (PARTITION BY user_id ORDER BY session_id, turn_index, role) AS pos,
                    count(*) OVER (PARTITION BY user_id) // 10 AS folds FROM chat)
SELECT user_id, kind, position, count(*) AS n_turns, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (
  SELECT user_id, n_chars, CASE WHEN folds > 0 AND pos <= 5 * folds + 1 THEN 'summary' ELSE 'turn' END AS kind,
         CASE WHEN folds > 0 AND pos <= 5 * folds + 1 THEN 0 ELSE pos END AS position FROM numbered) x GROUP BY 1, 2, 3""")
def chat_compaction(spark, sf_dir):
    """The compacted transcript of each user over all conversations: after every tenth turn the oldest six rows
    become one summary row."""
    t = chat_turns(spark, sf_dir).withColumn("n_chars", F.length("text"))
    return windows.compacted(t, "user_id", ["session_id", "turn_index", "role"], "n_chars")
