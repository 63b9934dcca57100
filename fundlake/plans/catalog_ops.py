"""Registered queries for data quality, history, windows and matched-control lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import exact, fiscal, money
from fundlake.functions.exact import ratio, ratio_sql
from fundlake.operators import history, lift, quality, windows
from fundlake.plans.catalog import FY, register as _reg_main  # noqa: F401
from fundlake.plans.model import Model
from fundlake.plans.oracle import q
from fundlake.plans.silver import conform_claims

REGISTRY: dict = {}
M = exact.money


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _m(spark: SparkSession, sf_dir: str) -> Model:
    return Model.for_session(spark, sf_dir)


def _sd(num, den, scale=2, mult=1):
    return ratio_sql(num, den, scale, mult, "duckdb")


# ------------------------------------------------------------------ shared SQL CTEs
DIRTY_SQL = """dirty AS (
  SELECT claim_id, CASE WHEN k % 977 = 0 THEN NULL ELSE dealer_id END AS dealer_id, program_id, activity_type_id,
         preapproval_id, submission_date,
         CASE WHEN k % 997 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE requested_amount_usd END AS requested_amount_usd,
         CASE WHEN k % 983 = 0 AND paid_amount_usd IS NOT NULL THEN CAST(approved_amount_usd + 1 AS DECIMAL(12,2))
              ELSE paid_amount_usd END AS paid_amount_usd,
         approved_amount_usd, CASE WHEN k % 991 = 0 THEN 'Bogus' ELSE status END AS status,
         brand_compliance_score, decision_date, payment_date, fy, k
  FROM coop_claim),
dirty_tagged AS (
  SELECT *, coalesce(requested_amount_usd > 0, false) AS r1,
         coalesce(status IN ('Draft','Submitted','Under_Review','Approved','Rejected','Paid','Expired'), false) AS r2,
         coalesce(paid_amount_usd IS NULL OR approved_amount_usd IS NULL OR paid_amount_usd <= approved_amount_usd, false) AS r3,
         coalesce(dealer_id IS NOT NULL, false) AS r4
  FROM dirty)"""

CHANGES_SQL = """account_changes AS (
  SELECT d.account_id, d.dealer_id, d.dealer_name, d.country, d.region_id, d.sales_rep_id,
         CASE WHEN v.kind = 'tier' THEN (CASE WHEN d.tier = 'Authorized' THEN 'Silver' WHEN d.tier = 'Silver' THEN 'Gold'
                                          ELSE 'Platinum' END) ELSE d.tier END AS tier,
         v.kind = 'delete' AS is_deleted, v.ts
  FROM dealer d JOIN (SELECT 'base' AS kind, TIMESTAMP '1995-01-01 00:00:00' AS ts
                      UNION ALL SELECT 'tier', TIMESTAMP '1998-03-01 00:00:00'
                      UNION ALL SELECT 'noop', TIMESTAMP '1996-06-01 00:00:00'
                      UNION ALL SELECT 'delete', TIMESTAMP '2000-01-01 00:00:00') v
    ON v.kind = 'base' OR (v.kind = 'tier' AND d.c_custkey % 7 = 0) OR (v.kind = 'noop' AND d.c_custkey % 11 = 0)
       OR (v.kind = 'delete' AND d.c_custkey % 97 = 0)),
ch_x AS (
  SELECT *, row_number() OVER w AS rn,
         lag(dealer_name) OVER w AS p_name, lag(tier) OVER w AS p_tier, lag(region_id) OVER w AS p_region,
         lag(country) OVER w AS p_country, lag(sales_rep_id) OVER w AS p_rep, lag(is_deleted) OVER w AS p_del
  FROM account_changes WINDOW w AS (PARTITION BY account_id ORDER BY ts)),
ch_y AS (
  SELECT * FROM ch_x
  WHERE rn = 1 OR is_deleted OR coalesce(p_del, false) OR dealer_name IS DISTINCT FROM p_name
        OR tier IS DISTINCT FROM p_tier OR region_id IS DISTINCT FROM p_region OR country IS DISTINCT FROM p_country
        OR sales_rep_id IS DISTINCT FROM p_rep),
ch_z AS (SELECT *, lead(ts) OVER (PARTITION BY account_id ORDER BY ts) AS next_ts FROM ch_y),
dealer_history AS (
  SELECT account_id, dealer_name, tier, region_id, country, sales_rep_id, dealer_id,
         CAST(ts AS DATE) AS effective_from, CAST(next_ts AS DATE) AS effective_to, next_ts IS NULL AS is_current
  FROM ch_z WHERE NOT is_deleted)"""

TRANSITIONS_SQL = """transitions AS (
  SELECT concat('TC-', cast(user_id AS string), '-', cast(event_id % 7 AS string)) AS claim_id,
         concat('D-', printf('%06d', user_id)) AS dealer_id, CAST(ts AS TIMESTAMP) AS ts, event_id,
         CASE event_type WHEN 'view' THEN 'Submitted' WHEN 'click' THEN 'Under_Review' WHEN 'signup' THEN 'Approved'
                         WHEN 'purchase' THEN 'Paid' WHEN 'error' THEN 'Rejected' END AS status
  FROM events),
moves AS (
  SELECT *, lag(status) OVER w AS prev_status, lag(status_rank) OVER w AS prev_rank,
         lead(ts) OVER w AS next_ts
  FROM (SELECT *, CASE status WHEN 'Draft' THEN 0 WHEN 'Submitted' THEN 1 WHEN 'Under_Review' THEN 2
                              WHEN 'Approved' THEN 3 WHEN 'Rejected' THEN 3 WHEN 'Paid' THEN 4 END AS status_rank
        FROM transitions) t
  WINDOW w AS (PARTITION BY claim_id ORDER BY ts, event_id))"""


def _dirty(m: Model) -> DataFrame:
    return m.dom.dirty_claims


def _changes(m: Model) -> DataFrame:
    c = m.dom.account_changes
    return c.select(F.col("Id").alias("account_id"), F.col("Dealer_External_Id__c").alias("dealer_id"),
                    F.col("Name").alias("dealer_name"), F.col("BillingCountry").alias("country"),
                    F.col("Region__c").alias("region_id"), F.col("Sales_Rep__c").alias("sales_rep_id"),
                    F.col("Tier__c").alias("tier"), F.col("IsDeleted").alias("is_deleted"),
                    F.col("LastModifiedDate").alias("ts"))


def _history(m: Model) -> DataFrame:
    return history.scd2(_changes(m), "account_id", "ts",
                        ["dealer_name", "tier", "region_id", "country", "sales_rep_id"], "is_deleted",
                        carry=["dealer_id"])


# ----------------------------------------------------------------------- quality
@register("quality_claim_rule_metrics", q("""
SELECT 'claim_amount_positive' AS rule_name, count_if(r1) AS passed, count_if(NOT r1) AS failed FROM dirty_tagged
UNION ALL SELECT 'status_valid', count_if(r2), count_if(NOT r2) FROM dirty_tagged
UNION ALL SELECT 'paid_le_approved', count_if(r3), count_if(NOT r3) FROM dirty_tagged
UNION ALL SELECT 'dealer_not_null', count_if(r4), count_if(NOT r4) FROM dirty_tagged""", DIRTY_SQL))
def quality_claim_rule_metrics(spark, sf_dir):
    """pass/fail counts per drop rule over the raw claim feed."""
    return quality.rule_metrics(_dirty(_m(spark, sf_dir)), quality.CLAIM_STREAM_RULES)


@register("quality_quarantine_claims", q("""
SELECT claim_id, concat_ws(',', CASE WHEN NOT r1 THEN 'claim_amount_positive' END,
                                CASE WHEN NOT r2 THEN 'status_valid' END,
                                CASE WHEN NOT r3 THEN 'paid_le_approved' END,
                                CASE WHEN NOT r4 THEN 'dealer_not_null' END) AS reason
FROM dirty_tagged WHERE NOT (r1 AND r2 AND r3 AND r4)""", DIRTY_SQL))
def quality_quarantine_claims(spark, sf_dir):
    """Quarantined rows with the names of the rules they failed."""
    _, bad = quality.split_quarantine(_dirty(_m(spark, sf_dir)), quality.CLAIM_STREAM_RULES)
    return bad.select("claim_id", "reason")


@register("quality_clean_claim_count", q("""
SELECT count(*) AS n_clean, CAST(sum(requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd
FROM dirty_tagged WHERE r1 AND r2 AND r3 AND r4""", DIRTY_SQL))
def quality_clean_claim_count(spark, sf_dir):
    """Rows surviving expect-or-drop."""
    clean = quality.apply_rules(_dirty(_m(spark, sf_dir)), quality.CLAIM_STREAM_RULES)
    return clean.agg(F.count(F.lit(1)).alias("n_clean"), M(F.sum("requested_amount_usd")).alias("requested_usd"))


@register("quality_reconcile_claims", q("""
SELECT coalesce(s.dealer_id, t.dealer_id) AS dealer_id, coalesce(s.fy, t.fy) AS fy,
       CAST(s.source_total AS DECIMAL(18,2)) AS source_total, CAST(t.target_total AS DECIMAL(18,2)) AS target_total,
       CAST(coalesce(s.source_total, 0) - coalesce(t.target_total, 0) AS DECIMAL(18,2)) AS difference
FROM (SELECT dealer_id, fy, sum(requested_amount_usd) AS source_total FROM dirty GROUP BY 1, 2) s
FULL OUTER JOIN (SELECT dealer_id, fy, sum(requested_amount_usd) AS target_total FROM dirty_tagged
                 WHERE r1 AND r2 AND r3 AND r4 GROUP BY 1, 2) t
  ON s.dealer_id = t.dealer_id AND s.fy = t.fy
WHERE coalesce(s.source_total, 0) - coalesce(t.target_total, 0) <> 0""", DIRTY_SQL))
def quality_reconcile_claims(spark, sf_dir):
    """Requested totals per dealer x FY, raw feed vs silver; rows that differ."""
    raw = _dirty(_m(spark, sf_dir))
    clean = quality.apply_rules(raw, quality.CLAIM_STREAM_RULES)
    r = quality.reconcile(raw, clean, ["dealer_id", "fy"], "requested_amount_usd")
    return r.select("dealer_id", "fy", M("source_total").alias("source_total"),
                    M("target_total").alias("target_total"), M("difference").alias("difference"))


@register("quality_orphan_claims", q("""
SELECT claim_id, dealer_id FROM dirty c
WHERE NOT EXISTS (SELECT 1 FROM s_dealer d WHERE d.dealer_id = c.dealer_id)"""
                                     , DIRTY_SQL))
def quality_orphan_claims(spark, sf_dir):
    """Claims whose dealer key is missing from the dealer dimension."""
    m = _m(spark, sf_dir)
    return quality.orphans(_dirty(m), m.silver.dealer, "dealer_id").select("claim_id", "dealer_id")


@register("quality_duplicate_order_lines", q("""
SELECT order_id, line_no, count(*) AS n_rows FROM s_order GROUP BY 1, 2 HAVING count(*) > 1"""))
def quality_duplicate_order_lines(spark, sf_dir):
    """(order, line) keys that occur more than once."""
    return quality.duplicate_keys(_m(spark, sf_dir).silver.sell_through_order, ["order_id", "line_no"])


@register("quality_missing_preapproval", q("""
SELECT c.claim_id, c.activity_type_id, c.requested_amount_usd, a.preapproval_threshold_usd
FROM s_claim c JOIN activity_type a ON c.activity_type_id = a.activity_type_id
WHERE a.requires_preapproval AND c.requested_amount_usd >= a.preapproval_threshold_usd AND c.preapproval_id IS NULL"""))
def quality_missing_preapproval(spark, sf_dir):
    """Required pre-approval missing at/above threshold (flag, not drop)."""
    m = _m(spark, sf_dir)
    a = F.broadcast(m.silver.activity_type.select("activity_type_id", "requires_preapproval",
                                                  "preapproval_threshold_usd"))
    j = m.silver.coop_claim.join(a, "activity_type_id")
    return (j.filter(F.col("requires_preapproval") & (F.col("requested_amount_usd") >= F.col("preapproval_threshold_usd"))
                     & F.col("preapproval_id").isNull())
            .select("claim_id", "activity_type_id", "requested_amount_usd", "preapproval_threshold_usd"))


@register("quality_program_single_fy", q("""
SELECT program_id, count(DISTINCT fiscal_year) AS n_fiscal_years FROM s_claim GROUP BY 1 HAVING count(DISTINCT fiscal_year) > 1"""))
def quality_program_single_fy(spark, sf_dir):
    """Guard: a program spanning two fiscal years would double-count claims in utilization."""
    c = _m(spark, sf_dir).silver.coop_claim
    return (c.groupBy("program_id").agg(F.countDistinct("fiscal_year").alias("n_fiscal_years"))
            .filter("n_fiscal_years > 1"))


@register("quality_ship_before_order", q("""
SELECT product_family, count(*) AS n_lines FROM s_order WHERE ship_date < order_date GROUP BY 1"""))
def quality_ship_before_order(spark, sf_dir):
    """D9-style validator: order lines shipped before they were ordered, per family."""
    o = _m(spark, sf_dir).silver.sell_through_order
    return o.filter(F.col("ship_date") < F.col("order_date")).groupBy("product_family").agg(
        F.count(F.lit(1)).alias("n_lines"))


# ----------------------------------------------------------------------- history
@register("scd2_dealer_history", q("""
SELECT account_id, dealer_id, dealer_name, tier, region_id, country, sales_rep_id, effective_from, effective_to, is_current
FROM dealer_history""", CHANGES_SQL))
def scd2_dealer_history(spark, sf_dir):
    """SCD-2 dealer versions from the account change feed."""
    h = _history(_m(spark, sf_dir))
    return h.select("account_id", "dealer_id", "dealer_name", "tier", "region_id", "country", "sales_rep_id",
                    "effective_from", "effective_to", "is_current")


@register("scd2_dealer_summary", q("""
SELECT count(*) AS n_versions, count_if(is_current) AS n_current,
       (SELECT count(*) FROM account_changes WHERE is_deleted) AS n_deletes
FROM dealer_history""", CHANGES_SQL))
def scd2_dealer_summary(spark, sf_dir):
    m = _m(spark, sf_dir)
    h = _history(m)
    n_del = _changes(m).filter("is_deleted").agg(F.count(F.lit(1))).scalar()
    return h.agg(F.count(F.lit(1)).alias("n_versions"), F.count_if("is_current").alias("n_current"),
                 n_del.alias("n_deletes"))


@register("cdc_latest_accounts", q("""
SELECT account_id, dealer_id, tier, ts AS last_modified FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC) AS rn FROM account_changes) x
WHERE rn = 1 AND NOT is_deleted""", CHANGES_SQL))
def cdc_latest_accounts(spark, sf_dir):
    """Latest change row per account, deletes dropped."""
    c = _changes(_m(spark, sf_dir)).select("account_id", "ts", "dealer_id", "tier", "is_deleted")
    r = history.latest_per_key(c, ["account_id"], "ts", drop_deleted="is_deleted")
    return r.select("account_id", "dealer_id", "tier", F.col("ts").alias("last_modified"))


@register("asof_claim_tier", q("""
SELECT c.claim_id, c.dealer_id, c.submission_date, h.tier AS tier_at_submission
FROM s_claim c LEFT JOIN dealer_history h
  ON c.dealer_id = h.dealer_id AND h.effective_from <= c.submission_date
 AND c.submission_date < coalesce(h.effective_to, DATE '9999-12-31')""", CHANGES_SQL))
def asof_claim_tier(spark, sf_dir):
    """Dealer tier valid on each claim's submission date."""
    m = _m(spark, sf_dir)
    c = m.silver.coop_claim.select("claim_id", "dealer_id", "submission_date")
    h = _history(m).select("dealer_id", "tier", "effective_from", "effective_to")
    r = history.asof_join(c, h, "dealer_id", "submission_date", ["tier"])
    return r.withColumnRenamed("tier", "tier_at_submission")


@register("snapshot_change_feed", q(f"""
SELECT coalesce(o.dealer_id, n.dealer_id) AS dealer_id, coalesce(o.program_id, n.program_id) AS program_id,
       CASE WHEN o.dealer_id IS NULL THEN 'insert' WHEN n.dealer_id IS NULL THEN 'delete' ELSE 'update' END AS change_type
FROM (SELECT * FROM util) n
FULL OUTER JOIN (SELECT a.dealer_id, a.program_id, CAST(a.expiration_date - DATE '2001-04-01' AS INTEGER) AS days_to_expiration
                 FROM alloc_agg a) o
  ON o.dealer_id = n.dealer_id AND o.program_id = n.program_id
WHERE o.dealer_id IS NULL OR n.dealer_id IS NULL OR o.days_to_expiration <> n.days_to_expiration"""))
def snapshot_change_feed(spark, sf_dir):
    """Changed keys between the 2001-04-01 and 2001-10-13 utilization snapshots
    (compared on days_to_expiration)."""
    new = _m(spark, sf_dir).utilization
    old = Model(spark, sf_dir, as_of="2001-04-01").utilization
    return history.snapshot_diff(old, new, ["dealer_id", "program_id"], ["days_to_expiration"])


# ----------------------------------------------------------------------- windows
@register("top_dealers_by_region", q(f"""
SELECT region, dealer_id, unused_usd, rank FROM (
  SELECT r.region, u.dealer_id, CAST(sum(u.unused_usd) AS DECIMAL(18,2)) AS unused_usd,
         row_number() OVER (PARTITION BY r.region ORDER BY sum(u.unused_usd) DESC, u.dealer_id) AS rank
  FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
  WHERE u.fiscal_year = '{FY}' GROUP BY r.region, u.dealer_id) x WHERE rank <= 3"""))
def top_dealers_by_region(spark, sf_dir):
    """G1 / H6: top 3 dealers by unused balance within each region (WindowGroupLimit)."""
    m = _m(spark, sf_dir)
    u = m.utilization.filter(F.col("fiscal_year") == FY).groupBy("dealer_id").agg(M(F.sum("unused_usd")).alias("unused_usd"))
    d = m.dealer_flat.select("dealer_id", "region")
    j = u.join(d, "dealer_id")
    r = windows.top_n_per_group(j, ["region"], [F.desc("unused_usd"), F.asc("dealer_id")], 3)
    return r.select("region", "dealer_id", "unused_usd", F.col("rank").cast("bigint").alias("rank"))


@register("activity_roi_rank", q(f"""
SELECT activity_type_id, rpd AS revenue_per_coop_dollar, dense_rank() OVER (ORDER BY rpd DESC) AS roi_rank
FROM (SELECT activity_type_id, {_sd('sum(attributed_revenue_usd)', 'sum(coop_paid_usd)', 2)} AS rpd
      FROM activity_lift GROUP BY 1) x"""))
def activity_roi_rank(spark, sf_dir):
    """Activities ranked by revenue per co-op dollar (dense rank over 22 rows)."""
    a = _m(spark, sf_dir).activity_lift.groupBy("activity_type_id").agg(
        F.sum("attributed_revenue_usd").alias("attr"), F.sum("coop_paid_usd").alias("paid"))
    a = a.select("activity_type_id", ratio("attr", "paid", 2).alias("revenue_per_coop_dollar"))
    r = windows.dense_rank_by(a, [F.desc("revenue_per_coop_dollar")], col="roi_rank")
    return r.withColumn("roi_rank", F.col("roi_rank").cast("bigint"))


@register("forfeiture_yoy", q("""
SELECT fiscal_year, forfeited_usd, lag(forfeited_usd) OVER (ORDER BY y) AS prior_forfeited_usd,
       CAST(forfeited_usd - lag(forfeited_usd) OVER (ORDER BY y) AS DECIMAL(18,2)) AS yoy_change_usd
FROM (SELECT fiscal_year, CAST(sum(forfeited_usd) AS DECIMAL(18,2)) AS forfeited_usd,
             CASE WHEN fiscal_year >= 'FY70' THEN '19' ELSE '20' END || substr(fiscal_year, 3) AS y FROM util GROUP BY 1) x"""))
def forfeiture_yoy(spark, sf_dir):
    """Forfeiture per fiscal year with the prior year (lag over the per-FY aggregate)."""
    u = _m(spark, sf_dir).utilization.groupBy("fiscal_year").agg(M(F.sum("forfeited_usd")).alias("forfeited_usd"))
    r = windows.with_prior(u.withColumn("fy", fiscal.fy_number("fiscal_year")), [], "fy", "forfeited_usd").drop("fy")
    return r.withColumn("yoy_change_usd", M(F.col("forfeited_usd") - F.col("prior_forfeited_usd")))


@register("claim_density_7d", q("""
SELECT dealer_id, max(n_7d) AS max_claims_7d, max(n_7d) > 20 AS exceeds_threshold FROM (
  SELECT dealer_id, sum(n_day) OVER (PARTITION BY dealer_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS n_7d
  FROM (SELECT dealer_id, submission_date AS day, count(*) AS n_day FROM s_claim GROUP BY 1, 2) d) x
GROUP BY dealer_id"""))
def claim_density_7d(spark, sf_dir):
    """Max claims filed by a dealer in any 7-day window, flagged above 20."""
    r = windows.rolling_density(_m(spark, sf_dir).silver.coop_claim, "dealer_id", "submission_date", 7)
    return (r.groupBy("dealer_id").agg(F.max("n_7d").alias("max_claims_7d"))
            .withColumn("exceeds_threshold", F.col("max_claims_7d") > 20))


@register("late_cycle_dumping", q(f"""
SELECT dealer_id, fiscal_year, n_all, n_window, {_sd('n_window', 'n_all', 4)} AS window_share
FROM (SELECT dealer_id, fiscal_year, count(*) AS n_all,
             count_if(month(submission_date) = 1 AND day(submission_date) >= 25) AS n_window
      FROM s_claim GROUP BY 1, 2) x
WHERE n_window * 10 > n_all * 3"""))
def late_cycle_dumping(spark, sf_dir):
    """Dealer-years with more than 30% of their claims in the last week of January."""
    c = _m(spark, sf_dir).silver.coop_claim
    in_w = (F.month("submission_date") == 1) & (F.dayofmonth("submission_date") >= 25)
    r = windows.share_in_window(c, ["dealer_id", "fiscal_year"], in_w)
    return (r.filter(F.col("n_window") * 10 > F.col("n_all") * 3)
            .select("dealer_id", "fiscal_year", "n_all", "n_window", ratio("n_window", "n_all", 4).alias("window_share")))


@register("double_dip_claims", q("""
SELECT claim_id, dealer_id, activity_type_id, submission_date, program_id, pos > 1 AS is_duplicate FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.dealer_id, c.activity_type_id, c.submission_date
                                 ORDER BY c.submission_date, c.claim_id) AS pos
  FROM s_claim c JOIN (SELECT dealer_id, activity_type_id, submission_date FROM s_claim GROUP BY 1, 2, 3
                       HAVING count(DISTINCT program_id) > 1) g
    ON c.dealer_id = g.dealer_id AND c.activity_type_id = g.activity_type_id AND c.submission_date = g.submission_date) x"""))
def double_dip_claims(spark, sf_dir):
    """Same dealer/activity/date filed under two programs; later filings flagged."""
    c = _m(spark, sf_dir).silver.coop_claim
    r = windows.duplicates_across(c, ["dealer_id", "activity_type_id", "submission_date"], "program_id",
                                  [F.col("submission_date"), F.col("claim_id")])
    return r.select("claim_id", "dealer_id", "activity_type_id", "submission_date", "program_id", "is_duplicate")


@register("status_backward_summary", q("""
SELECT count(DISTINCT claim_id) AS n_claims, count(*) AS n_rows, count_if(prev_rank > status_rank) AS n_backward
FROM moves""", TRANSITIONS_SQL))
def status_backward_summary(spark, sf_dir):
    """Monotonic-status check over transition rows."""
    mv = windows.status_moves(_m(spark, sf_dir).dom.claim_transitions, "claim_id", "ts", "status", "event_id")
    return mv.agg(F.countDistinct("claim_id").alias("n_claims"), F.count(F.lit(1)).alias("n_rows"),
                  F.count_if("is_backward").alias("n_backward"))


@register("status_backward_moves", q("""
SELECT claim_id, event_id, ts, prev_status, status FROM moves WHERE prev_rank > status_rank""", TRANSITIONS_SQL))
def status_backward_moves(spark, sf_dir):
    mv = windows.status_moves(_m(spark, sf_dir).dom.claim_transitions, "claim_id", "ts", "status", "event_id")
    return mv.filter("is_backward").select("claim_id", "event_id", "ts", "prev_status", "status")


@register("status_dwell_time", q(f"""
SELECT status, count(*) AS n_transitions,
       {_sd('sum(epoch_us(next_ts) // 1000000 - epoch_us(ts) // 1000000)', 'count(next_ts)', 1)} AS avg_dwell_seconds
FROM moves GROUP BY status""", TRANSITIONS_SQL))
def status_dwell_time(spark, sf_dir):
    """Average time spent in each status before the next transition."""
    mv = windows.status_moves(_m(spark, sf_dir).dom.claim_transitions, "claim_id", "ts", "status", "event_id")
    r = mv.groupBy("status").agg(F.count(F.lit(1)).alias("n_transitions"),
                                 F.sum("dwell_seconds").alias("s"), F.count("dwell_seconds").alias("n"))
    return r.select("status", "n_transitions", ratio("s", "n", 1).alias("avg_dwell_seconds"))


@register("preapproval_reuse", q("""
SELECT c.claim_id, c.preapproval_id, s.n_uses, s.first_use_date,
       CAST(c.submission_date - s.first_use_date AS INTEGER) AS days_since_first_use,
       (c.submission_date - s.first_use_date) > 90 AS is_expired_use
FROM s_claim c JOIN (SELECT preapproval_id, count(*) AS n_uses, min(submission_date) AS first_use_date
                     FROM s_claim WHERE preapproval_id IS NOT NULL GROUP BY 1) s ON c.preapproval_id = s.preapproval_id
WHERE s.n_uses > 1"""))
def preapproval_reuse(spark, sf_dir):
    """Pre-approval ids used by several claims, and uses beyond the 90-day validity."""
    c = _m(spark, sf_dir).silver.coop_claim.select("claim_id", "preapproval_id", "submission_date")
    r = windows.key_reuse(c, "preapproval_id", "submission_date", 90)
    return r.filter("is_reused").select("claim_id", "preapproval_id", "n_uses", "first_use_date",
                                        "days_since_first_use", "is_expired_use")


_BURN_SQL = """burn_events AS (
  SELECT dealer_id, program_id, submission_date AS day, requested_amount_usd AS committed_usd,
         CAST(0 AS DECIMAL(12,2)) AS paid_usd
  FROM s_claim WHERE status IN ('Submitted','Under_Review','Approved','Paid')
  UNION ALL
  SELECT dealer_id, program_id, payment_date, CAST(0 AS DECIMAL(12,2)), paid_amount_usd
  FROM s_claim WHERE status = 'Paid')"""


@register("burn_down_daily", q("""
SELECT dealer_id, program_id, day, CAST(committed_usd AS DECIMAL(18,2)) AS committed_usd,
       CAST(paid_usd AS DECIMAL(18,2)) AS paid_usd,
       CAST(sum(committed_usd) OVER w AS DECIMAL(18,2)) AS cum_committed_usd,
       CAST(sum(paid_usd) OVER w AS DECIMAL(18,2)) AS cum_paid_usd
FROM (SELECT dealer_id, program_id, day, sum(committed_usd) AS committed_usd, sum(paid_usd) AS paid_usd
      FROM burn_events GROUP BY 1, 2, 3) x
WINDOW w AS (PARTITION BY dealer_id, program_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                              _BURN_SQL))
def burn_down_daily(spark, sf_dir):
    """Cumulative committed and paid per dealer-program on each active day."""
    c = _m(spark, sf_dir).silver.coop_claim
    z = F.lit(0).cast("decimal(12,2)")
    ev = (c.filter(F.col("status").isin("Submitted", "Under_Review", "Approved", "Paid"))
          .select("dealer_id", "program_id", F.col("submission_date").alias("day"),
                  F.col("requested_amount_usd").alias("committed_usd"), z.alias("paid_usd"))
          .unionByName(c.filter(F.col("status") == "Paid")
                       .select("dealer_id", "program_id", F.col("payment_date").alias("day"),
                               z.alias("committed_usd"), F.col("paid_amount_usd").alias("paid_usd"))))
    r = windows.running_totals(ev, ["dealer_id", "program_id"], "day", ["committed_usd", "paid_usd"])
    return r.select("dealer_id", "program_id", "day", *[M(c_).alias(c_) for c_ in
                                                        ["committed_usd", "paid_usd", "cum_committed_usd",
                                                         "cum_paid_usd"]])


@register("forfeiture_rollup", q("""
SELECT r.region, r.sub_region, CAST(sum(u.unused_usd) AS DECIMAL(18,2)) AS unused_usd,
       CAST(grouping(r.region, r.sub_region) AS INTEGER) AS grouping_id
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
GROUP BY ROLLUP (r.region, r.sub_region)"""))
def forfeiture_rollup(spark, sf_dir):
    """F16: unused balance by region and sub-region with subtotals and grand total."""
    m = _m(spark, sf_dir)
    j = m.utilization.join(m.dealer_flat.select("dealer_id", "region", "sub_region"), "dealer_id")
    r = windows.subtotals(j, ["region", "sub_region"], [M(F.sum("unused_usd")).alias("unused_usd")], "rollup")
    return r


@register("forfeiture_cube", q("""
SELECT r.region, d.tier, CAST(sum(u.expected_forfeit_usd) AS DECIMAL(18,2)) AS expected_forfeit_usd,
       CAST(grouping(r.region, d.tier) AS INTEGER) AS grouping_id
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id JOIN dim_region r ON d.region_id = r.region_id
GROUP BY CUBE (r.region, d.tier)"""))
def forfeiture_cube(spark, sf_dir):
    """F16: expected forfeit by region x tier with every subtotal (CUBE)."""
    m = _m(spark, sf_dir)
    j = m.utilization.join(m.dealer_flat.select("dealer_id", "region", "tier"), "dealer_id")
    return windows.subtotals(j, ["region", "tier"], [M(F.sum("expected_forfeit_usd")).alias("expected_forfeit_usd")],
                             "cube")


@register("gap_to_target", q(f"""
SELECT dealer_id, program_id, gap_usd FROM (
  SELECT dealer_id, program_id,
         CAST(greatest(sum(allocated_usd) * CAST(0.92 AS DECIMAL(3,2)) - sum(paid_usd), 0) AS DECIMAL(18,2)) AS gap_usd
  FROM util WHERE fiscal_year = '{FY}' GROUP BY 1, 2) x WHERE gap_usd > 0"""))
def gap_to_target(spark, sf_dir):
    """max(0, 92% of allocation - paid) per dealer-program, current year."""
    u = _m(spark, sf_dir).utilization.filter(F.col("fiscal_year") == FY)
    g = u.groupBy("dealer_id", "program_id").agg(F.sum("allocated_usd").alias("a"), F.sum("paid_usd").alias("p"))
    gap = M(money.floor_zero(F.col("a") * F.lit("0.92").cast("decimal(3,2)") - F.col("p")))
    return g.select("dealer_id", "program_id", gap.alias("gap_usd")).filter(F.col("gap_usd") > 0)


@register("claim_status_pivot", q("""
SELECT fiscal_year,
       count_if(status = 'Approved') AS "Approved", count_if(status = 'Draft') AS "Draft",
       count_if(status = 'Expired') AS "Expired", count_if(status = 'Paid') AS "Paid",
       count_if(status = 'Rejected') AS "Rejected", count_if(status = 'Submitted') AS "Submitted",
       count_if(status = 'Under_Review') AS "Under_Review"
FROM s_claim GROUP BY fiscal_year"""))
def claim_status_pivot(spark, sf_dir):
    """status mix per fiscal year as columns (pivot with a declared value list)."""
    from fundlake.sources.domain import STATUSES
    c = _m(spark, sf_dir).silver.coop_claim
    p = c.groupBy("fiscal_year").pivot("status", sorted(STATUSES)).agg(F.count(F.lit(1)))
    return p.select("fiscal_year", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in sorted(STATUSES)])


# -------------------------------------------------------------------------- lift
_LIFT_SQL = """dm0 AS (
  SELECT p.dealer_id, p.month, p.net_revenue_usd,
         CAST(coalesce(sum(p.net_revenue_usd) OVER (PARTITION BY p.dealer_id ORDER BY p.month
                                                    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS base_revenue
  FROM perf p),
treated AS (
  SELECT m.dealer_id, m.month, sum(c.paid_amount_usd) AS prior_paid_usd
  FROM (SELECT DISTINCT dealer_id, month FROM perf) m
  JOIN s_claim c ON c.dealer_id = m.dealer_id AND c.status = 'Paid'
   AND c.payment_date >= m.month - INTERVAL 60 DAY AND c.payment_date < m.month
  GROUP BY 1, 2),
dm AS (
  SELECT dm0.*, r.region, d.tier, t.dealer_id IS NOT NULL AS treated
  FROM dm0 LEFT JOIN treated t ON dm0.dealer_id = t.dealer_id AND dm0.month = t.month
       LEFT JOIN s_dealer d ON dm0.dealer_id = d.dealer_id LEFT JOIN dim_region r ON d.region_id = r.region_id),
pairs AS (
  SELECT * FROM (
    SELECT t.region, t.tier, t.month, t.dealer_id AS t_dealer, c.dealer_id AS c_dealer, c.net_revenue_usd AS c_revenue,
           row_number() OVER (PARTITION BY t.region, t.tier, t.month, t.dealer_id
                              ORDER BY abs(c.base_revenue - t.base_revenue), c.dealer_id) AS match_rank
    FROM dm t JOIN dm c ON t.region = c.region AND t.tier = c.tier AND t.month = c.month
    WHERE t.treated AND NOT c.treated) x WHERE match_rank <= 5),
lift_rows AS (
  SELECT t.month AS month_start, t.dealer_id, t.region, t.tier, t.net_revenue_usd, t.base_revenue,
         CAST(coalesce(p.n_controls, 0) AS BIGINT) AS n_controls, CAST(p.s AS DECIMAL(18,2)) AS control_revenue_sum
  FROM dm t LEFT JOIN (SELECT region, tier, month, t_dealer, count(*) AS n_controls, sum(c_revenue) AS s
                       FROM pairs GROUP BY 1, 2, 3, 4) p
    ON t.region = p.region AND t.tier = p.tier AND t.month = p.month AND t.dealer_id = p.t_dealer
  WHERE t.treated)"""


def _lift_rows(spark, sf_dir) -> DataFrame:
    m = _m(spark, sf_dir)
    from fundlake.session import materialize
    return lift.matched_control_lift(m.dealer_performance, m.dealer_flat, m.silver.coop_claim,
                                     materialize=lambda d: materialize(d, "lift-dealer-months"))


@register("lift_treated_months", q("""
SELECT dealer_id, month AS month_start, CAST(prior_paid_usd AS DECIMAL(18,2)) AS prior_paid_usd FROM treated""",
                                   _LIFT_SQL))
def lift_treated_months(spark, sf_dir):
    """Dealer-months with co-op paid in the 60 days before the month (interval join)."""
    m = _m(spark, sf_dir)
    t = lift.treated_months(m.dealer_performance, m.silver.coop_claim)
    return t.select("dealer_id", F.col("month").alias("month_start"), M("prior_paid_usd").alias("prior_paid_usd"))


@register("lift_matched_control", q(f"""
SELECT month_start, dealer_id, region, tier, net_revenue_usd, n_controls,
       {_sd('control_revenue_sum', 'n_controls', 2)} AS control_mean_revenue,
       CAST(net_revenue_usd - {_sd('control_revenue_sum', 'n_controls', 2)} AS DECIMAL(18,2)) AS lift_usd,
       {_sd('net_revenue_usd - ' + _sd('control_revenue_sum', 'n_controls', 2), _sd('control_revenue_sum', 'n_controls', 2), 4)} AS lift_pct
FROM lift_rows""", _LIFT_SQL))
def lift_matched_control(spark, sf_dir):
    """Matched-control lift per treated dealer-month (k=5 nearest by base revenue)."""
    r = _lift_rows(spark, sf_dir)
    r = r.withColumn("control_mean_revenue", ratio("control_revenue_sum", "n_controls", 2))
    r = r.withColumn("lift_usd", M(F.col("net_revenue_usd") - F.col("control_mean_revenue")))
    return r.select("month_start", "dealer_id", "region", "tier", "net_revenue_usd", "n_controls",
                    "control_mean_revenue", "lift_usd", ratio("lift_usd", "control_mean_revenue", 4).alias("lift_pct"))


@register("lift_matched_control_summary", q("""
SELECT count(*) AS n_treated, count_if(n_controls > 0) AS n_matched, CAST(sum(n_controls) AS BIGINT) AS n_control_rows
FROM lift_rows""", _LIFT_SQL))
def lift_matched_control_summary(spark, sf_dir):
    r = _lift_rows(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("n_treated"), F.count_if(F.col("n_controls") > 0).alias("n_matched"),
                 F.sum("n_controls").cast("bigint").alias("n_control_rows"))


@register("lift_by_region_tier", q(f"""
SELECT region, tier, count(*) AS n_treated,
       {_sd('sum(net_revenue_usd)', 'count(*)', 2)} AS avg_treated_revenue,
       {_sd('sum(control_revenue_sum)', 'sum(n_controls)', 2)} AS avg_control_revenue
FROM lift_rows WHERE n_controls > 0 GROUP BY 1, 2""", _LIFT_SQL))
def lift_by_region_tier(spark, sf_dir):
    """E15 rollup: treated vs control mean revenue per cell."""
    r = _lift_rows(spark, sf_dir).filter("n_controls > 0")
    g = r.groupBy("region", "tier").agg(F.count(F.lit(1)).alias("n_treated"), F.sum("net_revenue_usd").alias("st"),
                                        F.sum("control_revenue_sum").alias("sc"), F.sum("n_controls").alias("nc"))
    return g.select("region", "tier", "n_treated", ratio("st", "n_treated", 2).alias("avg_treated_revenue"),
                    ratio("sc", "nc", 2).alias("avg_control_revenue"))


@register("dealer_performance_full_outer", q("""
SELECT count(*) AS n_rows, CAST(sum(coop_paid_usd) AS DECIMAL(18,2)) AS coop_paid_usd,
       CAST(sum(net_revenue_usd) AS DECIMAL(18,2)) AS net_revenue_usd
FROM (SELECT coalesce(r.net_revenue_usd, 0) AS net_revenue_usd, coalesce(p.coop_paid_usd, 0) AS coop_paid_usd
      FROM monthly_rev r FULL OUTER JOIN monthly_paid p ON r.dealer_id = p.dealer_id AND r.month_start = p.month_start) x"""))
def dealer_performance_full_outer(spark, sf_dir):
    """E3 variant: co-op paid in months without orders is kept (full outer)."""
    from fundlake.plans import gold
    m = _m(spark, sf_dir)
    f = gold.dealer_performance_monthly(m.silver.sell_through_order, m.silver.coop_claim, m.silver.dealer,
                                        keep_unmatched_paid=True)
    return f.agg(F.count(F.lit(1)).alias("n_rows"), M(F.sum("coop_paid_usd")).alias("coop_paid_usd"),
                 M(F.sum("net_revenue_usd")).alias("net_revenue_usd"))


_ = conform_claims  # re-exported for tests


# ------------------------------------------------------------------ as-of rates
CURRENCIES = ["EUR", "GBP", "JPY"]  # fixed values: quote currency by user_id % 3


def _quoted_events(spark, sf_dir):
    from fundlake.sources.driver import read_table
    e = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                                                   "user_id", "event_type", "value")
    cur = None
    for i, c in enumerate(CURRENCIES):
        cur = F.when(F.col("user_id") % 3 == i, F.lit(c)) if cur is None else cur.when(F.col("user_id") % 3 == i, F.lit(c))
    return e.withColumn("currency", cur)


@register("asof_rate_conversion", """
WITH ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value,
                   CASE user_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'JPY' END AS currency FROM events),
f AS (SELECT event_id, ts, currency FROM ev WHERE event_type <> 'purchase'),
t AS (SELECT event_id AS rate_event_id, ts AS rate_ts, currency, CAST(value AS DECIMAL(12,2)) AS rate
      FROM ev WHERE event_type = 'purchase')
SELECT f.event_id, f.currency, f.ts, t.rate_event_id, t.rate_ts, t.rate
FROM f ASOF LEFT JOIN t ON f.currency = t.currency AND f.ts >= t.rate_ts""")
def asof_rate_conversion(spark, sf_dir):
    """Every event priced at the latest quote of its currency at or before its time
    (quotes = purchase events); distributed as-of join without pairs or hot-key windows."""
    from fundlake.operators.asof import asof_latest
    e = _quoted_events(spark, sf_dir)
    facts = e.filter(F.col("event_type") != "purchase").select("currency", "ts", "event_id")
    ticks = e.filter(F.col("event_type") == "purchase").select(
        "currency", "ts", F.col("event_id").alias("rate_event_id"), F.col("value").cast("decimal(12,2)").alias("rate"))
    r = asof_latest(facts, ticks, "currency", "ts", ["event_id"], ["rate_event_id", "rate"])
    return r.select("event_id", "currency", "ts", "rate_event_id", F.col("tick_ts").alias("rate_ts"), "rate")
