"""Registered queries over stored tables: coercion reports (B1, C3), line keys (D15), bucketed catalog tables (A2), the
serving mirror (B6), revenue by group (M2) and saved views (K8, K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.functions import exact
from fundlake.operators import governance, quality, sinks
from fundlake.plans import refresh, saved_views, schemas
from fundlake.plans.catalog_rules import _USERS_SQL, users
from fundlake.plans.model import Model
from fundlake.plans.oracle import q
from fundlake.session import checkpoint_root, materialize
from fundlake.sources.driver import read_catalog_table, read_table

REGISTRY: dict = {}
M = exact.money


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------- coercion
def text_claims(m: Model) -> DataFrame:
    """Stand-in for a claim feed that lands as text: ``USD`` before the amount where the claim number is divisible
    by 97, a score of ``pending`` by 89, the date as day/month/year by 101; ``uploaded_by`` filled for every third
    claim, no ``reviewer_id``."""
    c = m.silver.coop_claim.drop("reviewer_id")
    k = F.substring("claim_id", 4, 32).cast("bigint")
    odd = {"requested_amount_usd": (97, F.concat(F.lit("USD "), F.col("requested_amount_usd").cast("string"))),
           "brand_compliance_score": (89, F.lit("pending")),
           "submission_date": (101, F.date_format("submission_date", "dd/MM/yyyy"))}
    text = [F.when(k % odd[n][0] == 0, odd[n][1]).otherwise(F.col(n).cast("string")).alias(n) if n in odd
            else F.col(n).cast("string").alias(n) for n in c.columns]
    return c.select(*text, F.when(k % 3 == 0, F.concat(F.lit("user-"), (k % 50).cast("string"))).alias("uploaded_by"))


def _coerced_claims(spark, sf_dir) -> tuple[str, list[tuple]]:
    path = checkpoint_root(spark, "coerced-claims")
    out, seen = sinks.coerce_observed(text_claims(Model.for_session(spark, sf_dir)), schemas.target("coop_claim"))
    sinks.overwrite(out, path)
    return path, sinks.coercion_rows("coop_claim", seen)


_K = "CAST(substr(claim_id, 4) AS BIGINT)"


@register("coerce_text_claims", q(f"""
SELECT claim_id, dealer_id, CASE WHEN {_K} % 101 <> 0 THEN submission_date END AS submission_date,
       CASE WHEN {_K} % 97 <> 0 THEN requested_amount_usd END AS requested_amount_usd, approved_amount_usd,
       paid_amount_usd, status, CASE WHEN {_K} % 89 <> 0 THEN brand_compliance_score END AS brand_compliance_score,
       reviewer_id, decision_date, fiscal_year FROM s_claim"""))
def coerce_text_claims(spark, sf_dir):
    """B1 (a job): claims that land as text, coerced to the silver schema and written; what cannot be read is null."""
    path, _ = _coerced_claims(spark, sf_dir)
    return spark.read.schema(schemas.target("coop_claim")).parquet(path).select(
        "claim_id", "dealer_id", "submission_date", "requested_amount_usd", "approved_amount_usd", "paid_amount_usd",
        "status", "brand_compliance_score", "reviewer_id", "decision_date", "fiscal_year")


_CLEAN_CASTS = ["approved_amount_usd", "paid_amount_usd", "decision_date", "payment_date"]


@register("coerce_text_claims_report", q(f"""
SELECT 'rows' AS kind, CAST(NULL AS VARCHAR) AS column_name, count(*) AS n_values FROM s_claim
UNION ALL SELECT 'missing', 'reviewer_id', count(*) FROM s_claim
UNION ALL SELECT 'dropped', 'uploaded_by', count(*) FROM s_claim WHERE {_K} % 3 = 0
UNION ALL SELECT 'failed_cast', 'requested_amount_usd', count(*) FROM s_claim WHERE {_K} % 97 = 0
UNION ALL SELECT 'failed_cast', 'brand_compliance_score', count(*) FROM s_claim WHERE {_K} % 89 = 0
UNION ALL SELECT 'failed_cast', 'submission_date', count(*) FROM s_claim WHERE {_K} % 101 = 0
""" + "\n".join(f"UNION ALL SELECT 'failed_cast', '{c}', 0" for c in _CLEAN_CASTS)))
def coerce_text_claims_report(spark, sf_dir):
    """What the coercion lost, counted in the pass that wrote the table: dropped values, failed casts and
    missing columns."""
    _, rows = _coerced_claims(spark, sf_dir)
    return spark.createDataFrame(rows, sinks.REPORT_SCHEMA).select("kind", "column_name", "n_values")


_TABLE_SQL = {
    "dealer": "s_dealer", "program": "s_program", "activity_type": "activity_type", "region": "dim_region",
    "coop_allocation": "s_allocation", "coop_claim": "s_claim", "sell_through_order": "s_order", "marketing_event": "events",
    "fact_coop_utilization_daily": "util", "fact_claim_sla": "claim_sla", "fact_dealer_performance_monthly": "perf",
    "fact_activity_lift": "activity_lift"}


@register("refresh_report", q("\nUNION ALL ".join(
    [f"SELECT '{t}' AS table_name, 'rows' AS kind, CAST(NULL AS VARCHAR) AS column_name, count(*) AS n_values FROM {s}"
     for t, s in _TABLE_SQL.items()] +
    ["SELECT 'fiscal_calendar', 'rows', NULL, CAST(make_date(max(fy) + 1, 3, 1) - make_date(min(fy), 3, 1) AS BIGINT) FROM fy_list"])))
def refresh_report(spark, sf_dir):
    """B1 + B3 (a job): all 13 tables coerced to their declared schemas as they are written; the report that this
    leaves (no table of a clean refresh loses a value, so each has its row count alone)."""
    out = checkpoint_root(spark, "refresh")
    refresh.refresh(spark, sf_dir, out)
    return spark.read.parquet(f"{out}/report")


# ------------------------------------------------------------------- keys
_SENT = f"""sent AS (
  SELECT order_line_id, net_revenue_usd, fiscal_year, 1 AS try FROM s_order
  UNION ALL SELECT order_line_id, net_revenue_usd, fiscal_year, 2 FROM s_order WHERE line_no = 3)"""


@register("quality_repeated_order_lines", q("""
SELECT fiscal_year, count(*) AS n_sent, count(DISTINCT order_line_id) AS n_kept, count(*) - count(DISTINCT order_line_id) AS n_quarantined,
       CAST(sum(CASE WHEN try = 2 THEN net_revenue_usd ELSE 0 END) AS DECIMAL(18,2)) AS quarantined_usd
FROM sent GROUP BY 1""", _SENT))
def quality_repeated_order_lines(spark, sf_dir):
    """D15 as a rule: of the order lines with one key one is kept and the others are quarantined.  The stand-in feed
    sends every line numbered 3 a second time."""
    o = Model.for_session(spark, sf_dir).silver.sell_through_order.select("order_line_id", "line_no", "net_revenue_usd", "fiscal_year")
    t = quality.repeats(o.unionByName(o.where("line_no = 3")), ["order_line_id"], ["net_revenue_usd"])
    return t.groupBy("fiscal_year").agg(
        F.sum("n_copies").alias("n_sent"), F.count(F.lit(1)).alias("n_kept"), F.sum(F.col("n_copies") - 1).alias("n_quarantined"),
        M(F.sum(F.col("total_net_revenue_usd") - F.col("net_revenue_usd"))).alias("quarantined_usd"))


# ------------------------------------------------------------- catalog tables (A2)
@register("catalog_dealer_balances", q("""
SELECT d.dealer_id, d.tier, CAST(u.unused_usd AS DECIMAL(18,2)) AS unused_usd, u.n_programs,
       CAST(p.net_revenue_usd AS DECIMAL(18,2)) AS net_revenue_usd, p.n_months
FROM s_dealer d
LEFT JOIN (SELECT dealer_id, sum(unused_usd) AS unused_usd, count(*) AS n_programs FROM util GROUP BY 1) u ON d.dealer_id = u.dealer_id
LEFT JOIN (SELECT dealer_id, sum(net_revenue_usd) AS net_revenue_usd, count(DISTINCT month) AS n_months FROM perf GROUP BY 1) p
  ON d.dealer_id = p.dealer_id"""))
def catalog_dealer_balances(spark, sf_dir):
    """A2 (a job): dealers, utilization and monthly performance stored as catalog tables in equal buckets of the
    dealer, read by name, summed and joined on it without an exchange."""
    names = refresh.publish_catalog(spark, Model.for_session(spark, sf_dir))
    dealer, util, perf = (read_catalog_table(spark, n) for n in names)
    u = util.groupBy("dealer_id").agg(M(F.sum("unused_usd")).alias("unused_usd"), F.count(F.lit(1)).alias("n_programs"))
    p = perf.groupBy("dealer_id").agg(M(F.sum("net_revenue_usd")).alias("net_revenue_usd"),
                                      F.countDistinct("month").alias("n_months"))
    return (dealer.select("dealer_id", "tier").join(u, "dealer_id", "left").join(p, "dealer_id", "left")
            .select("dealer_id", "tier", "unused_usd", "n_programs", "net_revenue_usd", "n_months"))


# ------------------------------------------------------------- serving mirror (B6), revenue (M2)
EARLIER = "2001-04-01"


@register("published_versions", q("""
SELECT fiscal_year, date_key, count(*) AS n_rows, CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd,
       DATE '2001-10-14' AS synced_on FROM util GROUP BY 1, 2"""))
def published_versions(spark, sf_dir):
    """B6 (a job): a history of one snapshot is published, then one of two; readers find the later snapshot alone."""
    m = Model(spark, sf_dir)
    first = Model(spark, sf_dir, as_of=EARLIER).utilization
    path = checkpoint_root(spark, "published")
    sinks.publish_version(first, path, synced_at=f"{EARLIER} 12:00:00")
    sinks.publish_version(materialize(first.unionByName(m.utilization), "history"), path, synced_at="2001-10-14 12:00:00")
    return sinks.read_published(spark, path).groupBy("fiscal_year", "date_key").agg(
        F.count(F.lit(1)).alias("n_rows"), M(F.sum("unused_usd")).alias("unused_usd"),
        F.max(F.col("synced_at").cast("date")).alias("synced_on"))


@register("governance_revenue", q("""
SELECT u.user_id, u.role, CASE WHEN u.role <> 'dealer' THEN CAST(sum(p.net_revenue_usd) AS DECIMAL(18,2)) END AS net_revenue_usd,
       CAST(sum(p.coop_paid_usd) AS DECIMAL(18,2)) AS coop_paid_usd
FROM users u LEFT JOIN perf p
  ON u.role IN ('director', 'finance') OR (u.role IN ('channel_mgr', 'rmd') AND p.region_id = u.region_id)
     OR (u.role = 'dealer' AND p.dealer_id = u.dealer_id)
GROUP BY 1, 2""", _USERS_SQL))
def governance_revenue(spark, sf_dir):
    """M1 + M2: each user's totals within their scope; revenue shows only to channel marketing and finance."""
    m = Model.for_session(spark, sf_dir)
    t = governance.scoped_totals(users(spark, m, sf_dir), m.dealer_performance, ["net_revenue_usd", "coop_paid_usd"])
    t = governance.limit_columns(t, "role", ["net_revenue_usd"], governance.REVENUE_GROUPS)
    return t.select("user_id", "role", M("net_revenue_usd").alias("net_revenue_usd"), M("coop_paid_usd").alias("coop_paid_usd"))


# --------------------------------------------------------------- saved views (K8, K9)
# The views that the stand-in's users save, by name, and what goes wrong with some requests.
_VIEWS = {
    "Asia by tier": '{"metric_view": "coop_program_metrics", "group_by": ["tier", "fiscal_year"], '
                    '"measures": ["allocated_usd", "unused_usd"], "filters": [{"dim": "region", "value": "ASIA"}]}',
    "Gold risk": '{"metric_view": "forfeiture_risk", "group_by": ["region"], "measures": ["unused_balance_usd"], '
                 '"filters": [{"dim": "tier", "value": "Gold"}]}',
    "Paid claims": '{"metric_view": "claim_lifecycle", "group_by": ["tier"], "measures": ["claims_paid"]}',
    "Revenue": '{"metric_view": "dealer_performance", "group_by": ["region", "month"], "measures": ["net_revenue_usd"]}'}
_WRONG = [(13, "malformed", '{"metric_view": "forfeiture_risk", "group_by": "region"'),
          (17, "unknown_view", '{"metric_view": "coop_sales", "group_by": ["region"]}'),
          (19, "nothing_asked", '{"metric_view": "forfeiture_risk", "filters": []}'),
          (23, "unknown_dimension", '{"metric_view": "forfeiture_risk", "group_by": ["region", "colour"]}'),
          (29, "unknown_measure", '{"metric_view": "activity_lift", "measures": ["weather"]}'),
          (31, "filter_without_value", '{"metric_view": "forfeiture_risk", "group_by": ["tier"], "filters": [{"dim": "tier"}]}'),
          (37, "malformed", '{"metric_view": "forfeiture_risk", "group_by": "region", "measures": ["unused_balance_usd"]}')]


def save_requests(spark, sf_dir) -> DataFrame:
    """Stand-in: every event is a request of one of ten users to save one of four views; payloads that must be
    refused where the event number is divisible by one of a few primes."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    names = list(_VIEWS)
    name, good = F.lit(names[0]), F.lit(_VIEWS[names[0]])
    for i, n in enumerate(names[1:], 1):
        name, good = F.when(k % len(names) == i, n).otherwise(name), F.when(k % len(names) == i, _VIEWS[n]).otherwise(good)
    payload = None
    for p, _, text in _WRONG:
        payload = F.when(k % p == 0, text) if payload is None else payload.when(k % p == 0, text)
    return e.select(F.concat(F.lit("U-"), (F.col("user_id") % 10).cast("string")).alias("user_id"), name.alias("name"),
                    F.col("ts").alias("saved_at"), k.alias("request_id"), (k % 3 == 0).alias("pinned"), payload.otherwise(good).alias("payload"))


_REQ_SQL = f"""req AS (
  SELECT concat('U-', CAST(user_id % 10 AS VARCHAR)) AS user_id,
         CASE event_id % {len(_VIEWS)} {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_VIEWS))} END AS name,
         ts AS saved_at, event_id AS request_id, event_id % 3 = 0 AS pinned,
         CASE {' '.join(f"WHEN event_id % {p} = 0 THEN '{r}'" for p, r, _ in _WRONG)} END AS refused,
         CASE event_id % {len(_VIEWS)} {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_VIEWS.values()))} END AS payload
  FROM events)"""


@register("saved_view_refusals", f"""WITH {_REQ_SQL}
SELECT coalesce(refused, 'accepted') AS outcome, count(*) AS n_requests, count(DISTINCT user_id) AS n_users FROM req GROUP BY 1""")
def saved_view_refusals(spark, sf_dir):
    """K9: requests to save a view by outcome: accepted, or why their payload is refused."""
    return saved_views.checked(save_requests(spark, sf_dir)).groupBy(F.coalesce("refused", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.countDistinct("user_id").alias("n_users"))


@register("saved_view_store", f"""WITH {_REQ_SQL}
SELECT user_id, name, saved_at, request_id, pinned, payload, n_saves FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, name) AS n_saves,
         row_number() OVER (PARTITION BY user_id, name ORDER BY saved_at DESC, request_id DESC) AS place
  FROM req WHERE refused IS NULL) x WHERE place = 1""")
def saved_view_store(spark, sf_dir):
    """K8 (a job): the accepted requests upserted by user and name into a stored table; the last one counts."""
    s = saved_views.stored(save_requests(spark, sf_dir), ["saved_at", "request_id"])
    return materialize(s, "saved-views").drop("view_id")


@register("saved_view_run_stored", q("""
SELECT d.tier, u.fiscal_year, CAST(round(sum(u.allocated_usd), 0) AS DECIMAL(18,0)) AS allocated_usd,
       CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
WHERE r.region = 'ASIA' GROUP BY 1, 2"""))
def saved_view_run_stored(spark, sf_dir):
    """K8 + K10 (a job): a view read from its stored row by user and name, checked, run and shown in its formats."""
    s = materialize(saved_views.stored(save_requests(spark, sf_dir), ["saved_at", "request_id"]), "saved-views")
    r = saved_views.run_stored(Model.for_session(spark, sf_dir), s, "U-3", "Asia by tier")
    return r.select("tier", "fiscal_year", M(F.col("allocated_usd"), 0).alias("allocated_usd"), M(F.col("unused_usd"), 0).alias("unused_usd"))
