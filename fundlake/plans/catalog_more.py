"""Registered queries for validators, link checks, saved views, list requests and small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundlake.functions import exact
from fundlake.operators import quality, sinks, workflow
from fundlake.plans import metrics
from fundlake.plans.catalog_ops import DIRTY_SQL, _dirty
from fundlake.plans.catalog_rules import _GAP_SQL, _gap_dealers
from fundlake.plans.model import Model
from fundlake.plans.oracle import q
from fundlake.session import checkpoint_root
from fundlake.sources.driver import SCHEMAS, read_catalog_table, read_table

REGISTRY: dict = {}
M = exact.money
LIST_IDS = 1000  # ids in one recipient list


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _m(spark: SparkSession, sf_dir: str) -> Model:
    return Model.for_session(spark, sf_dir)


# ---------------------------------------------------------------------- validators
_REQUIRED = ["claim_id", "dealer_id", "program_id", "preapproval_id", "brand_compliance_score"]


@register("quality_not_null_rules", q("\nUNION ALL ".join(
    f"SELECT '{c}_not_null' AS rule_name, count({c}) AS passed, count(*) - count({c}) AS failed FROM dirty"
    for c in _REQUIRED), DIRTY_SQL))
def quality_not_null_rules(spark, sf_dir):
    """NOT NULL validators made from the schema, counted over the raw claim feed."""
    claims = _dirty(_m(spark, sf_dir))
    return quality.rule_metrics(claims, quality.not_null_rules(claims.schema, _REQUIRED))


@register("quality_input_preflight", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, NOT EXISTS (SELECT 1 FROM {t}) AS is_empty" for t in SCHEMAS))
def quality_input_preflight(spark, sf_dir):
    """Which inputs are empty; each check reads one row at most."""
    return quality.preflight({t: read_table(spark, sf_dir, t) for t in SCHEMAS})


_KEYS = {"dealer": ("s_dealer", ["dealer_id"]), "coop_claim": ("s_claim", ["claim_id"]),
         "coop_allocation": ("s_allocation", ["allocation_id"]), "sell_through_order": ("s_order", ["order_line_id"]),
         "program": ("s_program", ["program_id"])}


@register("quality_silver_keys", q("\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_keys, count_if(n > 1) AS n_duplicate_keys "
    f"FROM (SELECT count(*) AS n FROM {v} GROUP BY {', '.join(k)}) x" for t, (v, k) in _KEYS.items())))
def quality_silver_keys(spark, sf_dir):
    """Keys and duplicated keys of each silver table."""
    silver, out = _m(spark, sf_dir).silver, None
    for t, (_, key) in _KEYS.items():
        one = getattr(silver, t).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------- filters, sorts
def claim_totals(claims: DataFrame, label: str, status: str | None = None, program_id: str | None = None) -> DataFrame:
    """A parameter that is None adds no filter."""
    for column, value in (("status", status), ("program_id", program_id)):
        if value is not None:
            claims = claims.filter(F.col(column) == value)
    return claims.agg(F.lit(label).alias("request"), F.count(F.lit(1)).alias("n_claims"),
                      M(F.sum("requested_amount_usd")).alias("requested_usd"))


@register("claims_optional_filters", q("""
SELECT 'all' AS request, count(*) AS n_claims, CAST(sum(requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd FROM s_claim
UNION ALL SELECT 'paid', count(*), CAST(sum(requested_amount_usd) AS DECIMAL(18,2)) FROM s_claim WHERE status = 'Paid'
UNION ALL SELECT 'paid-main', count(*), CAST(sum(requested_amount_usd) AS DECIMAL(18,2)) FROM s_claim
WHERE status = 'Paid' AND program_id = 'PRG-2000-MAIN'"""))
def claims_optional_filters(spark, sf_dir):
    """The same request with no, one and two parameters."""
    c = _m(spark, sf_dir).silver.coop_claim
    return claim_totals(c, "all").unionByName(claim_totals(c, "paid", "Paid")) \
        .unionByName(claim_totals(c, "paid-main", "Paid", "PRG-2000-MAIN"))


@register("events_recent", """
SELECT event_id, event_type FROM events WHERE CAST(ts AS TIMESTAMP) > (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 5 MINUTE""")
def events_recent(spark, sf_dir):
    """Events of the five minutes up to the latest one."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return e.filter(F.col("ts") > e.agg(F.max("ts")).scalar() - F.expr("interval 5 minutes")).select("event_id", "event_type")


_URGENCY = {"Under_Review": 0, "Submitted": 1, "Approved": 2, "Rejected": 3}  # fixed values: order of the work list


@register("claims_by_urgency", q("""
SELECT claim_id, status FROM s_claim
ORDER BY CASE status WHEN 'Under_Review' THEN 0 WHEN 'Submitted' THEN 1 WHEN 'Approved' THEN 2 WHEN 'Rejected' THEN 3 ELSE 4 END,
         requested_amount_usd DESC, claim_id LIMIT 50"""))
def claims_by_urgency(spark, sf_dir):
    """H4: the top of the work list by a rank made from the status."""
    rank = F.lit(len(_URGENCY))
    for status, r in _URGENCY.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    c = _m(spark, sf_dir).silver.coop_claim
    return c.orderBy(rank, F.desc("requested_amount_usd"), "claim_id").limit(50).select("claim_id", "status")


@register("saved_view_list", """
SELECT user_id, event_type AS view_name, pinned, last_used,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC NULLS LAST, last_used DESC NULLS LAST, event_type) AS INTEGER) AS place
FROM (SELECT user_id, event_type, CASE WHEN user_id % 11 <> 0 THEN (user_id + length(event_type)) % 3 = 0 END AS pinned,
             max(CASE WHEN value > 50 THEN CAST(ts AS TIMESTAMP) END) AS last_used
      FROM events GROUP BY user_id, event_type) v""")
def saved_view_list(spark, sf_dir):
    """Q19 / H3: each user's views (a view for each event type), pinned ones first, then the last used;
    unknown values last.  The window runs over at most one row for each event type of a user."""
    v = read_table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("view_name")).agg(
        F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("last_used"))
    v = v.withColumn("pinned", F.when(F.col("user_id") % 11 != 0, (F.col("user_id") + F.length("view_name")) % 3 == 0))
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("pinned"), F.desc_nulls_last("last_used"), "view_name")
    return v.select("user_id", "view_name", "pinned", "last_used", F.row_number().over(w).alias("place"))


# ------------------------------------------------------------------ lists and links
def _lists(m: Model) -> DataFrame:
    number = F.substring("dealer_id", 3, 32).cast("bigint")
    return _gap_dealers(m).groupBy("region_id", F.floor(number / LIST_IDS).alias("part")) \
        .agg(F.sort_array(F.collect_set("dealer_id")).alias("dealer_ids"))


@register("campaign_id_lists", q(f"""
SELECT region_id, custkey // {LIST_IDS} AS part, string_agg(DISTINCT dealer_id, ',' ORDER BY dealer_id) AS dealer_ids
FROM gap GROUP BY 1, 2""", _GAP_SQL))
def campaign_id_lists(spark, sf_dir):
    """the dealers below target of each region as sorted lists of at most 1,000 ids."""
    return _lists(_m(spark, sf_dir)).select("region_id", "part", F.array_join("dealer_ids", ",").alias("dealer_ids"))


@register("campaign_recipients", q("""
SELECT g.region_id, g.dealer_id, d.dealer_name, d.tier FROM gap g LEFT JOIN s_dealer d ON g.dealer_id = d.dealer_id""", _GAP_SQL))
def campaign_recipients(spark, sf_dir):
    """The ids of the lists, each resolved against the dealers."""
    m = _m(spark, sf_dir)
    return workflow.resolve_recipients(_lists(m), m.silver.dealer.select("dealer_id", "dealer_name", "tier")) \
        .select("region_id", "dealer_id", "dealer_name", "tier")


@register("event_claim_link", q("""
SELECT e.event_id, c.claim_id, c.status, CAST(count(*) OVER (PARTITION BY e.event_id) AS BIGINT) AS n_rows
FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN concat('CL-', printf('%08d', event_id)) END AS claim_id FROM events) e
LEFT JOIN s_claim c ON e.claim_id = c.claim_id"""))
def event_claim_link(spark, sf_dir):
    """An event has no claim or one; purchases name the claim with the event's number, which may be missing."""
    from fundlake.sources.domain import padded
    m = _m(spark, sf_dir)
    e = read_table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_type") == "purchase", F.concat(F.lit("CL-"), padded(F.col("event_id"), 8))).alias("claim_id"))
    named = e.filter("claim_id is not null").join(m.silver.coop_claim.select("claim_id", "status"), "claim_id")
    found = named.groupBy("event_id").agg(F.max("claim_id").alias("claim_id"), F.max("status").alias("status"),
                                          F.count(F.lit(1)).alias("n"))
    return e.select("event_id").join(found, "event_id", "left") \
        .select("event_id", "claim_id", "status", F.coalesce("n", F.lit(1).cast("bigint")).alias("n_rows"))


@register("claim_run_difference", q("""
SELECT 'only_before' AS side, count(*) AS n_rows FROM (
  SELECT claim_id, dealer_id, status, requested_amount_usd FROM coop_claim
  EXCEPT ALL SELECT claim_id, dealer_id, status, requested_amount_usd FROM dirty) a
UNION ALL SELECT 'only_after', count(*) FROM (
  SELECT claim_id, dealer_id, status, requested_amount_usd FROM dirty
  EXCEPT ALL SELECT claim_id, dealer_id, status, requested_amount_usd FROM coop_claim) b""", DIRTY_SQL))
def claim_run_difference(spark, sf_dir):
    """I4: rows that only one of two runs of the claim feed has, both ways."""
    m, cols = _m(spark, sf_dir), ["claim_id", "dealer_id", "status", "requested_amount_usd"]
    before, after = m.dom.coop_claim.select(*cols), _dirty(m).select(*cols)
    n = F.count(F.lit(1)).alias("n_rows")
    return before.exceptAll(after).agg(F.lit("only_before").alias("side"), n) \
        .unionByName(after.exceptAll(before).agg(F.lit("only_after").alias("side"), n))


@register("feed_diagonal_union", q("""
SELECT dealer_id, count(claim_id) AS n_claims, count(allocation_id) AS n_allocations, count(*) AS n_rows FROM (
  SELECT dealer_id, claim_id, CAST(NULL AS VARCHAR) AS allocation_id FROM s_claim
  UNION ALL SELECT dealer_id, NULL, allocation_id FROM s_allocation) x GROUP BY dealer_id"""))
def feed_diagonal_union(spark, sf_dir):
    """Feeds with different columns under one another, missing ones null."""
    s = _m(spark, sf_dir).silver
    both = s.coop_claim.select("dealer_id", "claim_id").unionByName(
        s.coop_allocation.select("dealer_id", "allocation_id"), allowMissingColumns=True)
    return both.groupBy("dealer_id").agg(F.count("claim_id").alias("n_claims"), F.count("allocation_id").alias("n_allocations"),
                                         F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------- semantic layer
_SAVED_VIEW = {"view": "forfeiture_risk", "dims": ["region", "fiscal_year"],
               "measures": ["unused_balance_usd", "dealers_at_risk_count"], "filters": [["tier", "Gold"]]}


@register("saved_view_run", q("""
SELECT r.region, u.fiscal_year, CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_balance_usd,
       count(DISTINCT CASE WHEN u.unused_usd > 0 AND u.days_to_expiration < 90 THEN u.dealer_id END) AS dealers_at_risk_count
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
WHERE d.tier = 'Gold' GROUP BY 1, 2"""))
def saved_view_run(spark, sf_dir):
    """A stored payload, validated, run and shown in its display formats."""
    r = metrics.formatted(metrics.run_saved_view(_m(spark, sf_dir), _SAVED_VIEW), _SAVED_VIEW["view"])
    return r.select("region", "fiscal_year", M(F.col("unused_balance_usd"), 0).alias("unused_balance_usd"), "dealers_at_risk_count")


# The terms that requests use, by order number.
_TERMS = ["Revenue", "balance", " leakage", "Tactic", "co-op", "weather"]


@register("term_resolution", """
WITH asked AS (SELECT trim(lower(CASE o_orderkey % 6 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'balance' WHEN 2 THEN ' leakage'
                                 WHEN 3 THEN 'Tactic' WHEN 4 THEN 'co-op' ELSE 'weather' END)) AS term FROM orders),
known(term, target) AS (VALUES ('revenue', 'net_revenue_usd'), ('balance', 'unused_usd'), ('balance', 'unused_balance_usd'),
  ('leakage', 'forfeited_usd'), ('leakage', 'expected_forfeit_usd'), ('tactic', 'activity_name'), ('co-op', 'program_name'))
SELECT a.term, n_requests, coalesce(targets, '') AS targets, coalesce(n_targets, 0) > 1 AS ambiguous
FROM (SELECT term, count(*) AS n_requests FROM asked GROUP BY term) a
LEFT JOIN (SELECT term, string_agg(target, ',' ORDER BY target) AS targets, count(*) AS n_targets FROM known GROUP BY term) k
  ON a.term = k.term""")
def term_resolution(spark, sf_dir):
    """K7: requested business terms counted, each with the names it may mean."""
    word = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("o_orderkey") % len(_TERMS) + 1).cast("int"))
    asked = read_table(spark, sf_dir, "orders").groupBy(F.trim(F.lower(word)).alias("term")) \
        .agg(F.count(F.lit(1)).alias("n_requests"))
    known = metrics.synonym_table(spark).groupBy("term").agg(F.sort_array(F.collect_set("target")).alias("t"))
    return asked.join(known, "term", "left").select(
        "term", "n_requests", F.coalesce(F.array_join("t", ","), F.lit("")).alias("targets"),
        F.coalesce(F.size("t") > 1, F.lit(False)).alias("ambiguous"))


@register("score_regression", q("""
SELECT activity_type_id, month, p50, prev_p50, coalesce(p50 < prev_p50 - 5, false) AS regressed
FROM (SELECT *, lag(p50) OVER (PARTITION BY activity_type_id ORDER BY month) AS prev_p50
      FROM (SELECT activity_type_id, CAST(date_trunc('month', submission_date) AS DATE) AS month,
                   quantile_cont(CAST(brand_compliance_score AS DOUBLE), 0.5) AS p50
            FROM s_claim WHERE brand_compliance_score IS NOT NULL GROUP BY 1, 2) x) y"""))
def score_regression(spark, sf_dir):
    """Median score of each monthly run beside the run before; a drop of over five points is a regression."""
    c = _m(spark, sf_dir).silver.coop_claim.filter("brand_compliance_score is not null")
    runs = c.groupBy("activity_type_id", F.trunc("submission_date", "month").alias("month")) \
        .agg(F.percentile("brand_compliance_score", 0.5).alias("p50"))
    w = Window.partitionBy("activity_type_id").orderBy("month")
    return runs.withColumn("prev_p50", F.lag("p50").over(w)) \
        .withColumn("regressed", F.coalesce(F.col("p50") < F.col("prev_p50") - 5, F.lit(False)))


@register("page_fragments", r"""
SELECT page_id, substr(url_decode(regexp_extract(url, '#(.*)$', 1)), 1, 280) AS fragment,
       regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def page_fragments(spark, sf_dir):
    """URL functions: a page's decoded fragment, cut at 280 characters, and its host."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.substring(F.url_decode(F.regexp_extract("url", "#(.*)$", 1)), 1, 280).alias("fragment"),
                    F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


# --------------------------------------------------------------- catalog and sinks
@register("catalog_dealers_by_tier", q("SELECT tier, count(*) AS n_dealers FROM s_dealer GROUP BY tier"))
def catalog_dealers_by_tier(spark, sf_dir):
    """A2: a table read by its catalog name."""
    _m(spark, sf_dir).silver.dealer.createOrReplaceTempView("fundlake_dealer")
    return read_catalog_table(spark, "fundlake_dealer").groupBy("tier").agg(F.count(F.lit(1)).alias("n_dealers"))


@register("published_utilization", q("""
SELECT fiscal_year, count(*) AS n_rows, CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd,
       DATE '2001-10-13' AS synced_on FROM util GROUP BY fiscal_year"""))
def published_utilization(spark, sf_dir):
    """B6 (a job): the latest snapshot is written for serving and read back."""
    path = checkpoint_root(spark, "published")
    sinks.publish_latest(_m(spark, sf_dir).utilization, path, synced_at="2001-10-13 12:00:00")
    return spark.read.parquet(path).groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("n_rows"), M(F.sum("unused_usd")).alias("unused_usd"),
        F.max(F.col("synced_at").cast("date")).alias("synced_on"))


@register("audit_appends", """
SELECT event_type AS action, CAST(ts AS DATE) AS day, count(*) AS n_rows FROM events
WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2""")
def audit_appends(spark, sf_dir):
    """B10 (a job): two append-only runs into one audit table, read back; the second is tried twice."""
    path = checkpoint_root(spark, "audit")
    e = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"), "ts")
    for action in ("purchase", "error", "error"):
        sinks.append_run(e.filter(F.col("action") == action), path, action)
    return spark.read.parquet(path).groupBy("action", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))

