"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables of ``sf_dir``.  Column names and output types are identical on
both sides (money as decimal(18,2), rates via ``functions.exact``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import exact
from fundlake.functions.exact import ratio, ratio_sql
from fundlake.plans import gold, metrics
from fundlake.plans.model import Model
from fundlake.plans.oracle import q

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

# Question parameters on the driver data (current fiscal year at the
# 2001-10-13 snapshot, one AMERICA sub-region, its main program).
FY = "FY01"
REGION = "AMERICA"
REGION_FULL = "AMERICA NATION_1"
REGION_ID = "RGN-AMERICA-1"
PROGRAM_ID = "PRG-2001-MAIN"
TIER = "Silver"
DEALER_ID = "D-000007"
ACTIVITY_A = "ACT-00"
ACTIVITY_B = "ACT-01"
REGION_PREFIX = "EUROPE%"
EXPIRY_WINDOW_DAYS = 180  # the as-of sits 138 days before FY end; see README


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _m(spark, sf_dir) -> Model:
    return Model.for_session(spark, sf_dir)


def _sd(num, den, scale=2, mult=1):
    return ratio_sql(num, den, scale, mult, "duckdb")


M = exact.money

# ------------------------------------------------------------------------ silver / gold


@register("silver_dealer", q("SELECT * FROM s_dealer"))
def silver_dealer(spark, sf_dir):
    return _m(spark, sf_dir).silver.dealer


@register("silver_coop_claim", q("SELECT * FROM s_claim"))
def silver_coop_claim(spark, sf_dir):
    return _m(spark, sf_dir).silver.coop_claim


@register("silver_coop_allocation", q("SELECT * FROM s_allocation"))
def silver_coop_allocation(spark, sf_dir):
    return _m(spark, sf_dir).silver.coop_allocation


@register("silver_sell_through_order", q("SELECT * FROM s_order"))
def silver_sell_through_order(spark, sf_dir):
    return _m(spark, sf_dir).silver.sell_through_order


@register("silver_program", q("SELECT * FROM s_program"))
def silver_program(spark, sf_dir):
    return _m(spark, sf_dir).silver.program


@register("silver_activity_type", q("SELECT * FROM activity_type"))
def silver_activity_type(spark, sf_dir):
    return _m(spark, sf_dir).silver.activity_type


@register("silver_region", q("SELECT region_id, region, sub_region, region_full, default_currency FROM dim_region"))
def silver_region(spark, sf_dir):
    return _m(spark, sf_dir).silver.region


_CAL_SQL = q("""
SELECT date_key,
       concat('FY', lpad(cast(fyn % 100 AS string), 2, '0')) AS fiscal_year,
       concat('P', lpad(cast(((month(date_key) + 9) % 12) + 1 AS string), 2, '0')) AS fiscal_period,
       CAST((date_key - make_date(fyn, 3, 1)) // 7 + 1 AS INTEGER) AS fiscal_week,
       concat('Q', cast((((month(date_key) + 9) % 12)) // 3 + 1 AS string)) AS fiscal_quarter,
       dayofweek(date_key) NOT IN (0, 6) AS is_business_day
FROM (SELECT date_key, year(date_key) - CASE WHEN month(date_key) < 3 THEN 1 ELSE 0 END AS fyn
      FROM (SELECT CAST(unnest(generate_series(CAST(make_date(min(fy), 3, 1) AS TIMESTAMP),
                                              CAST(make_date(max(fy) + 1, 3, 1) - 1 AS TIMESTAMP),
                                              INTERVAL 1 DAY)) AS DATE) AS date_key FROM fy_list) s) t
""")


@register("silver_fiscal_calendar", _CAL_SQL)
def silver_fiscal_calendar(spark, sf_dir):
    return _m(spark, sf_dir).silver.fiscal_calendar_from_data()


@register("gold_utilization", q("SELECT * FROM util"))
def gold_utilization(spark, sf_dir):
    return _m(spark, sf_dir).utilization


@register("gold_claim_sla", q("SELECT * FROM claim_sla"))
def gold_claim_sla(spark, sf_dir):
    return _m(spark, sf_dir).claim_sla


@register("gold_dealer_performance_monthly", q("SELECT * FROM perf"))
def gold_dealer_performance_monthly(spark, sf_dir):
    return _m(spark, sf_dir).dealer_performance


@register("gold_activity_lift", q("SELECT * FROM activity_lift"))
def gold_activity_lift(spark, sf_dir):
    return _m(spark, sf_dir).activity_lift


@register("gold_utilization_bands", q(f"""
SELECT CASE WHEN days_to_expiration < 0 THEN 'EXPIRED'
            WHEN days_to_expiration < 180 AND paid_usd < CAST(0.6 AS DECIMAL(2,1)) * greatest(allocated_usd, 1) THEN 'HIGH'
            ELSE 'LOW' END AS band,
       count(*) AS n_rows, CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd,
       CAST(sum(expected_forfeit_usd) AS DECIMAL(18,2)) AS expected_forfeit_usd
FROM util GROUP BY 1"""))
def gold_utilization_bands(spark, sf_dir):
    u = _m(spark, sf_dir).utilization
    return (u.groupBy(gold.risk_band().alias("band"))
            .agg(F.count(F.lit(1)).alias("n_rows"), M(F.sum("unused_usd")).alias("unused_usd"),
                 M(F.sum("expected_forfeit_usd")).alias("expected_forfeit_usd")))


# ------------------------------------------------------------------ certified questions
_FR_JOIN = """util u LEFT JOIN s_dealer d ON u.dealer_id = d.dealer_id
              LEFT JOIN dim_region r ON d.region_id = r.region_id"""
_LATEST = "u.date_key = (SELECT max(date_key) FROM util)"


@register("q_forfeiture_risk_region", q(f"""
SELECT CAST(sum(u.expected_forfeit_usd) AS DECIMAL(18,2)) AS expected_forfeit_usd,
       CAST(sum(u.unused_usd) AS DECIMAL(18,2)) AS unused_usd
FROM {_FR_JOIN} WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}'"""))
def q_forfeiture_risk_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", [], ["expected_forfeit_usd_total", "unused_usd_total"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL})
    return r.select(M("expected_forfeit_usd_total").alias("expected_forfeit_usd"),
                    M("unused_usd_total").alias("unused_usd"))


@register("q_at_risk_dealers", q(f"""
SELECT dealer_name, tier, unused_usd, paid_usd, {_sd('paid_usd', 'allocated_usd', 1, 100)} AS utilization_pct,
       expiration_date
FROM (SELECT d.dealer_name, d.tier, CAST(round(sum(u.unused_usd), 2) AS DECIMAL(18,2)) AS unused_usd,
             CAST(round(sum(u.paid_usd), 2) AS DECIMAL(18,2)) AS paid_usd, sum(u.allocated_usd) AS allocated_usd,
             min(u.date_key + u.days_to_expiration) AS expiration_date
      FROM {_FR_JOIN} WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}'
      GROUP BY d.dealer_name, d.tier) x
ORDER BY unused_usd DESC, dealer_name LIMIT 23"""))
def q_at_risk_dealers(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", ["dealer_name", "tier"],
                      ["unused_usd_total", "paid_usd_total", "allocated_usd_total", "expiration_date_min"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL})
    return (r.select("dealer_name", "tier", M(F.round("unused_usd_total", 2)).alias("unused_usd"),
                     M(F.round("paid_usd_total", 2)).alias("paid_usd"),
                     ratio("paid_usd_total", "allocated_usd_total", 1, 100).alias("utilization_pct"),
                     F.col("expiration_date_min").alias("expiration_date"))
            .orderBy(F.desc("unused_usd"), "dealer_name").limit(23))


_CL_JOIN = "claim_sla c LEFT JOIN dim_region r ON c.region_id = r.region_id"


@register("q_claims_under_review", q(f"""
SELECT r.region_full, count_if(c.final_status = 'Under_Review') AS claims_under_review
FROM {_CL_JOIN} WHERE c.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}' GROUP BY r.region_full"""))
def q_claims_under_review(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "claim_lifecycle", ["region_full"], ["claims_under_review_count"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL})
    return r.select("region_full", F.col("claims_under_review_count").alias("claims_under_review"))


@register("q_allocated_paid_by_region", q(f"""
SELECT r.region_full, CAST(round(sum(u.allocated_usd), 0) AS DECIMAL(18,0)) AS allocated_usd,
       CAST(round(sum(u.paid_usd), 0) AS DECIMAL(18,0)) AS paid_usd,
       CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd
FROM {_FR_JOIN} WHERE u.fiscal_year = '{FY}' AND u.program_id = '{PROGRAM_ID}'
GROUP BY r.region_full ORDER BY paid_usd DESC"""))
def q_allocated_paid_by_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "coop_program_metrics", ["region_full"],
                      ["allocated_usd_total", "paid_usd_total", "unused_usd_total"],
                      where={"fiscal_year": FY, "program_id": PROGRAM_ID})
    return (r.select("region_full", M(F.round("allocated_usd_total", 0), 0).alias("allocated_usd"),
                     M(F.round("paid_usd_total", 0), 0).alias("paid_usd"),
                     M(F.round("unused_usd_total", 0), 0).alias("unused_usd"))
            .orderBy(F.desc("paid_usd")))


@register("q_cycle_time_by_tier", q(f"""
SELECT tier, {_sd('s_total', 'n_total', 1)} AS avg_total_cycle_days,
       {_sd('s_s2d', 'n_s2d', 1)} AS avg_submit_to_decision, {_sd('s_d2p', 'n_d2p', 1)} AS avg_decision_to_pay
FROM (SELECT c.tier, sum(total_cycle_days) AS s_total, count(total_cycle_days) AS n_total,
             sum(days_submission_to_decision) AS s_s2d, count(days_submission_to_decision) AS n_s2d,
             sum(days_decision_to_payment) AS s_d2p, count(days_decision_to_payment) AS n_d2p
      FROM {_CL_JOIN} WHERE c.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}' AND c.tier = '{TIER}'
      GROUP BY c.tier) x"""))
def q_cycle_time_by_tier(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "claim_lifecycle", ["tier"],
                      ["sum_total_cycle_days", "n_total_cycle_days", "sum_days_submission_to_decision",
                       "n_days_submission_to_decision", "sum_days_decision_to_payment", "n_days_decision_to_payment"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL, "tier": TIER})
    return r.select("tier", ratio("sum_total_cycle_days", "n_total_cycle_days", 1).alias("avg_total_cycle_days"),
                    ratio("sum_days_submission_to_decision", "n_days_submission_to_decision", 1)
                    .alias("avg_submit_to_decision"),
                    ratio("sum_days_decision_to_payment", "n_days_decision_to_payment", 1)
                    .alias("avg_decision_to_pay"))


@register("q_expiring_dealers", q(f"""
SELECT d.dealer_name, d.tier, CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd,
       min(u.date_key + u.days_to_expiration) AS expiration_date, min(u.days_to_expiration) AS days_to_expiration
FROM {_FR_JOIN} WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}'
  AND u.days_to_expiration BETWEEN 0 AND {EXPIRY_WINDOW_DAYS}
GROUP BY d.dealer_name, d.tier ORDER BY days_to_expiration"""))
def q_expiring_dealers(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", ["dealer_name", "tier"],
                      ["unused_usd_total", "expiration_date_min", "days_to_expiration"],
                      where=[("fiscal_year", FY), ("region_full", REGION_FULL),
                             ("days_to_expiration_dim", "between", (0, EXPIRY_WINDOW_DAYS))])
    return (r.select("dealer_name", "tier", M(F.round("unused_usd_total", 0), 0).alias("unused_usd"),
                     F.col("expiration_date_min").alias("expiration_date"), "days_to_expiration")
            .orderBy("days_to_expiration"))


_AL_JOIN = "activity_lift al LEFT JOIN activity_type atp ON al.activity_type_id = atp.activity_type_id " \
           "LEFT JOIN dim_region r ON al.region_id = r.region_id"


@register("q_top_activities_roi", q(f"""
SELECT activity_name, category, {_sd('attr', 'paid', 2)} AS revenue_per_coop_dollar,
       CAST(round(attr, 0) AS DECIMAL(18,0)) AS attributed_revenue_usd, CAST(round(paid, 0) AS DECIMAL(18,0)) AS coop_paid_usd
FROM (SELECT atp.activity_name, atp.category, sum(al.attributed_revenue_usd) AS attr, sum(al.coop_paid_usd) AS paid
      FROM {_AL_JOIN} WHERE al.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}'
      GROUP BY atp.activity_name, atp.category) x
ORDER BY revenue_per_coop_dollar DESC, activity_name LIMIT 5"""))
def q_top_activities_roi(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["activity_name", "activity_category"],
                      ["attributed_revenue_usd_total", "coop_paid_usd_total"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL})
    return (r.select("activity_name", F.col("activity_category").alias("category"),
                     ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2).alias("revenue_per_coop_dollar"),
                     M(F.round("attributed_revenue_usd_total", 0), 0).alias("attributed_revenue_usd"),
                     M(F.round("coop_paid_usd_total", 0), 0).alias("coop_paid_usd"))
            .orderBy(F.desc("revenue_per_coop_dollar"), "activity_name").limit(5))


@register("q_lift_by_category", q(f"""
SELECT category, {_sd('attr', 'paid', 2)} AS avg_revenue_per_coop_dollar,
       CAST(round(attr, 0) AS DECIMAL(18,0)) AS attributed_revenue_usd, distinct_activities
FROM (SELECT atp.category, sum(al.attributed_revenue_usd) AS attr, sum(al.coop_paid_usd) AS paid,
             count(DISTINCT al.activity_type_id) AS distinct_activities
      FROM {_AL_JOIN} WHERE al.fiscal_year = '{FY}' GROUP BY atp.category) x
ORDER BY avg_revenue_per_coop_dollar DESC"""))
def q_lift_by_category(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["activity_category"],
                      ["attributed_revenue_usd_total", "coop_paid_usd_total", "distinct_activities"],
                      where={"fiscal_year": FY})
    return (r.select(F.col("activity_category").alias("category"),
                     ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2)
                     .alias("avg_revenue_per_coop_dollar"),
                     M(F.round("attributed_revenue_usd_total", 0), 0).alias("attributed_revenue_usd"),
                     "distinct_activities")
            .orderBy(F.desc("avg_revenue_per_coop_dollar")))


_DP_JOIN = "perf p LEFT JOIN s_dealer d ON p.dealer_id = d.dealer_id LEFT JOIN dim_region r ON d.region_id = r.region_id"


@register("q_monthly_revenue_by_tier", q(f"""
SELECT strftime(p.month, '%Y-%m') AS month_label, d.tier,
       CAST(round(sum(p.net_revenue_usd), 0) AS DECIMAL(18,0)) AS net_revenue_usd,
       CAST(round(sum(p.coop_paid_usd), 0) AS DECIMAL(18,0)) AS coop_paid_usd,
       CAST(round(sum(p.attributed_coop_usd_lift), 0) AS DECIMAL(18,0)) AS attributed_lift_usd
FROM {_DP_JOIN} WHERE p.fiscal_year = '{FY}' AND r.region_full = '{REGION_FULL}'
GROUP BY 1, 2 ORDER BY 1, 2"""))
def q_monthly_revenue_by_tier(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "dealer_performance", ["month", "tier"],
                      ["net_revenue_usd_total", "coop_paid_usd_total", "attributed_coop_usd_lift_total"],
                      where={"fiscal_year": FY, "region_full": REGION_FULL})
    return (r.select(F.date_format("month", "yyyy-MM").alias("month_label"), "tier",
                     M(F.round("net_revenue_usd_total", 0), 0).alias("net_revenue_usd"),
                     M(F.round("coop_paid_usd_total", 0), 0).alias("coop_paid_usd"),
                     M(F.round("attributed_coop_usd_lift_total", 0), 0).alias("attributed_lift_usd"))
            .orderBy("month_label", "tier"))


@register("q_activity_trend_region", q(f"""
SELECT fiscal_year, region_full, CAST(round(paid, 0) AS DECIMAL(18,0)) AS coop_paid_usd,
       CAST(round(attr, 0) AS DECIMAL(18,0)) AS attributed_revenue_usd, {_sd('attr', 'paid', 2)} AS revenue_per_coop_dollar
FROM (SELECT al.fiscal_year, r.region_full, sum(al.coop_paid_usd) AS paid, sum(al.attributed_revenue_usd) AS attr
      FROM {_AL_JOIN} WHERE al.activity_type_id = '{ACTIVITY_A}' AND r.region LIKE '{REGION_PREFIX}'
      GROUP BY 1, 2) x ORDER BY 1, 2"""))
def q_activity_trend_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["fiscal_year", "region_full"],
                      ["coop_paid_usd_total", "attributed_revenue_usd_total"],
                      where=[("activity_type_id", ACTIVITY_A), ("region", "like", REGION_PREFIX)])
    return (r.select("fiscal_year", "region_full", M(F.round("coop_paid_usd_total", 0), 0).alias("coop_paid_usd"),
                     M(F.round("attributed_revenue_usd_total", 0), 0).alias("attributed_revenue_usd"),
                     ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2).alias("revenue_per_coop_dollar"))
            .orderBy("fiscal_year", "region_full"))


@register("q_roi_by_region", q(f"""
SELECT region, {_sd('attr', 'paid', 2)} AS avg_revenue_per_coop_dollar,
       CAST(round(attr, 0) AS DECIMAL(18,0)) AS attributed_revenue_usd
FROM (SELECT r.region, sum(al.attributed_revenue_usd) AS attr, sum(al.coop_paid_usd) AS paid
      FROM {_AL_JOIN} WHERE al.fiscal_year = '{FY}' GROUP BY r.region) x ORDER BY 2 DESC"""))
def q_roi_by_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["region"],
                      ["attributed_revenue_usd_total", "coop_paid_usd_total"], where={"fiscal_year": FY})
    return (r.select("region", ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2)
                     .alias("avg_revenue_per_coop_dollar"),
                     M(F.round("attributed_revenue_usd_total", 0), 0).alias("attributed_revenue_usd"))
            .orderBy(F.desc("avg_revenue_per_coop_dollar")))


@register("q_high_roi_activities", q(f"""
SELECT activity_name, category, region_full, {_sd('attr', 'paid', 2)} AS revenue_per_coop_dollar
FROM (SELECT atp.activity_name, atp.category, r.region_full, sum(al.attributed_revenue_usd) AS attr,
             sum(al.coop_paid_usd) AS paid
      FROM {_AL_JOIN} WHERE al.fiscal_year = '{FY}' GROUP BY 1, 2, 3) x
WHERE {_sd('attr', 'paid', 2)} > 5 ORDER BY revenue_per_coop_dollar DESC"""))
def q_high_roi_activities(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["activity_name", "activity_category", "region_full"],
                      ["attributed_revenue_usd_total", "coop_paid_usd_total"], where={"fiscal_year": FY})
    out = r.select("activity_name", F.col("activity_category").alias("category"), "region_full",
                   ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2).alias("revenue_per_coop_dollar"))
    return out.filter(F.col("revenue_per_coop_dollar") > 5).orderBy(F.desc("revenue_per_coop_dollar"))


# ---------------------------------------------------------------------- role homes
@register("q_region_home", q(f"""
SELECT CAST(sum(u.unused_usd) AS DECIMAL(18,2)) AS unused_usd, CAST(sum(u.allocated_usd) AS DECIMAL(18,2)) AS allocated_usd,
       CAST(sum(u.paid_usd) AS DECIMAL(18,2)) AS paid_usd, count(DISTINCT u.dealer_id) AS dealer_count,
       {_sd('sum(u.paid_usd)', 'sum(u.allocated_usd)', 1, 100)} AS utilization_pct
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id
WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND d.region_id = '{REGION_ID}'"""))
def q_region_home(spark, sf_dir):
    m = _m(spark, sf_dir)
    u = m.utilization
    u = u.filter(F.col("date_key") == m.latest_snapshot())
    j = u.filter(F.col("fiscal_year") == FY).join(m.dim_dealer.filter(F.col("region_id") == REGION_ID)
                                                  .select("dealer_id"), "dealer_id")
    r = j.agg(F.sum("unused_usd").alias("u"), F.sum("allocated_usd").alias("a"), F.sum("paid_usd").alias("p"),
              F.countDistinct("dealer_id").alias("dealer_count"))
    return r.select(M("u").alias("unused_usd"), M("a").alias("allocated_usd"), M("p").alias("paid_usd"),
                    "dealer_count", ratio("p", "a", 1, 100).alias("utilization_pct"))


@register("q_region_home_at_risk", q(f"""
SELECT d.dealer_name, CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd
FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id
WHERE {_LATEST} AND u.fiscal_year = '{FY}' AND d.region_id = '{REGION_ID}'
GROUP BY d.dealer_name HAVING sum(u.unused_usd) > 40000 ORDER BY unused_usd DESC, dealer_name LIMIT 5"""))
def q_region_home_at_risk(spark, sf_dir):
    m = _m(spark, sf_dir)
    u = m.utilization
    u = u.filter(F.col("date_key") == m.latest_snapshot())
    j = u.filter(F.col("fiscal_year") == FY).join(
        m.dim_dealer.filter(F.col("region_id") == REGION_ID).select("dealer_id", "dealer_name"), "dealer_id")
    r = j.groupBy("dealer_name").agg(F.sum("unused_usd").alias("s")).filter(F.col("s") > 40000)
    return (r.select("dealer_name", M(F.round("s", 0), 0).alias("unused_usd"))
            .orderBy(F.desc("unused_usd"), "dealer_name").limit(5))


@register("q_global_home", q(f"""
SELECT CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd, CAST(sum(paid_usd) AS DECIMAL(18,2)) AS paid_usd,
       CAST(sum(allocated_usd) AS DECIMAL(18,2)) AS allocated_usd,
       {_sd('sum(paid_usd)', 'sum(allocated_usd)', 1, 100)} AS utilization_pct
FROM util u WHERE {_LATEST} AND fiscal_year = '{FY}'"""))
def q_global_home(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", [],
                      ["unused_usd_total", "paid_usd_total", "allocated_usd_total"], where={"fiscal_year": FY})
    return r.select(M("unused_usd_total").alias("unused_usd"), M("paid_usd_total").alias("paid_usd"),
                    M("allocated_usd_total").alias("allocated_usd"),
                    ratio("paid_usd_total", "allocated_usd_total", 1, 100).alias("utilization_pct"))


@register("q_global_home_by_region", q(f"""
SELECT r.region, CAST(round(sum(u.unused_usd), 0) AS DECIMAL(18,0)) AS unused_usd,
       {_sd('sum(u.paid_usd)', 'sum(u.allocated_usd)', 1, 100)} AS util_pct
FROM {_FR_JOIN} WHERE {_LATEST} AND u.fiscal_year = '{FY}' GROUP BY r.region ORDER BY unused_usd DESC"""))
def q_global_home_by_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", ["region"],
                      ["unused_usd_total", "paid_usd_total", "allocated_usd_total"], where={"fiscal_year": FY})
    return (r.select("region", M(F.round("unused_usd_total", 0), 0).alias("unused_usd"),
                     ratio("paid_usd_total", "allocated_usd_total", 1, 100).alias("util_pct"))
            .orderBy(F.desc("unused_usd")))


@register("q_finance_home", q(f"""
SELECT CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd, CAST(sum(paid_usd) AS DECIMAL(18,2)) AS paid_usd,
       CAST(sum(committed_usd) AS DECIMAL(18,2)) AS committed_usd, CAST(sum(approved_usd) AS DECIMAL(18,2)) AS approved_usd,
       CAST(greatest(sum(approved_usd) - sum(paid_usd), 0) AS DECIMAL(18,2)) AS accrual_usd
FROM util u WHERE {_LATEST} AND fiscal_year = '{FY}'"""))
def q_finance_home(spark, sf_dir):
    from fundlake.functions import money as mn
    r = metrics.query(_m(spark, sf_dir), "coop_program_metrics", [],
                      ["unused_usd", "paid_usd", "committed_usd", "approved_usd"],
                      where={"fiscal_year": FY})
    return r.select(M("unused_usd").alias("unused_usd"), M("paid_usd").alias("paid_usd"),
                    M("committed_usd").alias("committed_usd"), M("approved_usd").alias("approved_usd"),
                    M(mn.accrual("approved_usd", "paid_usd")).alias("accrual_usd"))


@register("q_dealer_home", q(f"""
SELECT CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd, CAST(sum(paid_usd) AS DECIMAL(18,2)) AS paid_usd,
       CAST(sum(allocated_usd) AS DECIMAL(18,2)) AS allocated_usd, CAST(sum(approved_usd) AS DECIMAL(18,2)) AS approved_usd
FROM util u WHERE {_LATEST} AND fiscal_year = '{FY}' AND dealer_id = '{DEALER_ID}'"""))
def q_dealer_home(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "coop_program_metrics", [],
                      ["unused_usd", "paid_usd", "allocated_usd", "approved_usd"],
                      where={"fiscal_year": FY, "dealer_id": DEALER_ID})
    return r.select(*[M(c).alias(c) for c in ["unused_usd", "paid_usd", "allocated_usd", "approved_usd"]])


# --------------------------------------------------------------- cohort sanity (Q20)
_COHORT = f"""cohort AS (
  SELECT u.*, d.dealer_name FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id
  WHERE u.fiscal_year = '{FY}' AND u.days_to_expiration BETWEEN 0 AND 179
    AND u.paid_usd < CAST(0.6 AS DECIMAL(2,1)) * greatest(u.allocated_usd, 1))"""


@register("q_cohort_summary", q("""
SELECT CAST(sum(expected_forfeit_usd) AS DECIMAL(18,2)) AS expected_total, count(DISTINCT dealer_id) AS dealer_count
FROM cohort""", _COHORT))
def q_cohort_summary(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    return c.agg(M(F.sum("expected_forfeit_usd")).alias("expected_total"),
                 F.countDistinct("dealer_id").alias("dealer_count"))


@register("q_cohort_top3", q("""
SELECT dealer_id, dealer_name, CAST(sum(expected_forfeit_usd) AS DECIMAL(18,2)) AS expected_forfeit_usd
FROM cohort GROUP BY 1, 2 ORDER BY expected_forfeit_usd DESC, dealer_id LIMIT 3""", _COHORT))
def q_cohort_top3(spark, sf_dir):
    c = _cohort(spark, sf_dir)
    return (c.groupBy("dealer_id", "dealer_name").agg(M(F.sum("expected_forfeit_usd")).alias("expected_forfeit_usd"))
            .orderBy(F.desc("expected_forfeit_usd"), "dealer_id").limit(3))


def _cohort(spark, sf_dir) -> DataFrame:
    from fundlake.functions import money as mn
    m = _m(spark, sf_dir)
    u = m.utilization.filter((F.col("fiscal_year") == FY) & F.col("days_to_expiration").between(0, m.horizon_days - 1)
                             & mn.under_utilization("paid_usd", "allocated_usd"))
    return u.join(m.dim_dealer.select("dealer_id", "dealer_name"), "dealer_id")


# ------------------------------------------------------------ exploration set (Q21)
@register("q_claims_by_status", q("SELECT status, count(*) AS n_claims FROM s_claim GROUP BY status"))
def q_claims_by_status(spark, sf_dir):
    return _m(spark, sf_dir).silver.coop_claim.groupBy("status").agg(F.count(F.lit(1)).alias("n_claims"))


@register("q_approved_by_program", q("""
SELECT program_id, CAST(sum(approved_amount_usd) AS DECIMAL(18,2)) AS approved_usd
FROM s_claim WHERE status IN ('Approved','Paid') GROUP BY program_id"""))
def q_approved_by_program(spark, sf_dir):
    c = _m(spark, sf_dir).silver.coop_claim
    return (c.filter(F.col("status").isin("Approved", "Paid")).groupBy("program_id")
            .agg(M(F.sum("approved_amount_usd")).alias("approved_usd")))


@register("q_median_score_by_tier", q("""
SELECT d.tier, CAST(quantile_cont(c.brand_compliance_score, 0.5) AS DECIMAL(10,2)) AS median_score
FROM s_claim c LEFT JOIN s_dealer d ON c.dealer_id = d.dealer_id GROUP BY d.tier"""))
def q_median_score_by_tier(spark, sf_dir):
    m = _m(spark, sf_dir)
    j = m.silver.coop_claim.join(m.dim_dealer.select("dealer_id", "tier"), "dealer_id", "left")
    return j.groupBy("tier").agg(F.percentile("brand_compliance_score", 0.5).cast("decimal(10,2)")
                                 .alias("median_score"))


@register("q_unused_by_program", q(f"""
SELECT program_id, CAST(sum(unused_usd) AS DECIMAL(18,2)) AS unused_usd FROM util u WHERE {_LATEST} GROUP BY program_id"""))
def q_unused_by_program(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "forfeiture_risk", ["program_id"], ["unused_usd_total"])
    return r.select("program_id", M("unused_usd_total").alias("unused_usd"))


@register("q_rejection_rate_by_region", q(f"""
SELECT region, {_sd('n_rej', 'n_all', 4)} AS rejection_rate
FROM (SELECT r.region, count_if(c.final_status = 'Rejected') AS n_rej, count(*) AS n_all
      FROM {_CL_JOIN} GROUP BY r.region) x"""))
def q_rejection_rate_by_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "claim_lifecycle", ["region"], ["claims_rejected", "claims_submitted"])
    return r.select("region", ratio("claims_rejected", "claims_submitted", 4).alias("rejection_rate"))


@register("q_first_pass_by_region", q(f"""
SELECT region, {_sd('n_fp', 'n_all', 4)} AS first_pass_approval_rate
FROM (SELECT r.region, count_if(c.first_pass_approval = TRUE) AS n_fp, count(*) AS n_all
      FROM {_CL_JOIN} GROUP BY r.region) x"""))
def q_first_pass_by_region(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "claim_lifecycle", ["region"], ["claims_first_pass", "claims_submitted"])
    return r.select("region", ratio("claims_first_pass", "claims_submitted", 4).alias("first_pass_approval_rate"))


@register("q_cycle_percentiles_by_tier", q("""
SELECT tier, CAST(quantile_cont(total_cycle_days, 0.5) AS DECIMAL(10,2)) AS cycle_time_days_p50,
       CAST(quantile_cont(total_cycle_days, 0.9) AS DECIMAL(10,2)) AS cycle_time_days_p90,
       CAST(quantile_cont(days_review_to_decision, 0.5) AS DECIMAL(10,2)) AS time_in_review_p50,
       CAST(quantile_cont(days_decision_to_payment, 0.5) AS DECIMAL(10,2)) AS time_to_pay_p50
FROM claim_sla GROUP BY tier"""))
def q_cycle_percentiles_by_tier(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "claim_lifecycle", ["tier"],
                      ["cycle_time_days_p50", "cycle_time_days_p90", "time_in_review_p50", "time_to_pay_p50"])
    return r.select("tier", *[F.col(c).cast("decimal(10,2)").alias(c) for c in
                              ["cycle_time_days_p50", "cycle_time_days_p90", "time_in_review_p50", "time_to_pay_p50"]])


# --------------------------------------------------------------- ROI exploration (Q22)
@register("q_lift_per_claim_by_tier", q("""
SELECT l.tier, CAST(l.lift AS DECIMAL(18,2)) AS attributed_lift_usd, c.n_paid AS paid_claims,
       """ + _sd("l.lift", "c.n_paid", 2) + """ AS lift_per_paid_claim
FROM (SELECT tier, sum(attributed_coop_usd_lift) AS lift FROM perf GROUP BY tier) l
JOIN (SELECT tier, count_if(final_status = 'Paid') AS n_paid FROM claim_sla GROUP BY tier) c ON l.tier = c.tier"""))
def q_lift_per_claim_by_tier(spark, sf_dir):
    m = _m(spark, sf_dir)
    lift = metrics.query(m, "dealer_performance", ["tier"], ["attributed_coop_usd_lift_total"])
    paid = metrics.query(m, "claim_lifecycle", ["tier"], ["claims_paid"])
    j = lift.join(paid, "tier")
    return j.select("tier", M("attributed_coop_usd_lift_total").alias("attributed_lift_usd"),
                    F.col("claims_paid").alias("paid_claims"),
                    ratio("attributed_coop_usd_lift_total", "claims_paid", 2).alias("lift_per_paid_claim"))


@register("q_digital_vs_event", q(f"""
SELECT category, CAST(sum(al.coop_paid_usd) AS DECIMAL(18,2)) AS coop_paid_usd,
       CAST(sum(al.attributed_revenue_usd) AS DECIMAL(18,2)) AS attributed_revenue_usd,
       {_sd('sum(al.attributed_revenue_usd)', 'sum(al.coop_paid_usd)', 2)} AS revenue_per_coop_dollar
FROM {_AL_JOIN} WHERE atp.category IN ('Digital', 'Event') GROUP BY category"""))
def q_digital_vs_event(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["activity_category"],
                      ["coop_paid_usd_total", "attributed_revenue_usd_total"],
                      where=[("activity_category", "in", ["Digital", "Event"])])
    return r.select(F.col("activity_category").alias("category"), M("coop_paid_usd_total").alias("coop_paid_usd"),
                    M("attributed_revenue_usd_total").alias("attributed_revenue_usd"),
                    ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2).alias("revenue_per_coop_dollar"))


@register("q_top10_dealers_revenue", q("""
SELECT p.dealer_id, d.dealer_name, CAST(sum(p.net_revenue_usd) AS DECIMAL(18,2)) AS net_revenue_usd
FROM perf p LEFT JOIN s_dealer d ON p.dealer_id = d.dealer_id
GROUP BY 1, 2 ORDER BY net_revenue_usd DESC, dealer_id LIMIT 10"""))
def q_top10_dealers_revenue(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "dealer_performance", ["dealer_id", "dealer_name"], ["net_revenue_usd_total"])
    return (r.select("dealer_id", "dealer_name", M("net_revenue_usd_total").alias("net_revenue_usd"))
            .orderBy(F.desc("net_revenue_usd"), "dealer_id").limit(10))


@register("q_activity_compare", q(f"""
SELECT activity_type_id, CAST(sum(coop_paid_usd) AS DECIMAL(18,2)) AS coop_paid_usd,
       CAST(sum(attributed_revenue_usd) AS DECIMAL(18,2)) AS attributed_revenue_usd,
       {_sd('sum(attributed_revenue_usd)', 'sum(coop_paid_usd)', 2)} AS revenue_per_coop_dollar
FROM activity_lift WHERE activity_type_id IN ('{ACTIVITY_A}', '{ACTIVITY_B}') GROUP BY activity_type_id"""))
def q_activity_compare(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["activity_type_id"],
                      ["coop_paid_usd_total", "attributed_revenue_usd_total"],
                      where=[("activity_type_id", "in", [ACTIVITY_A, ACTIVITY_B])])
    return r.select("activity_type_id", M("coop_paid_usd_total").alias("coop_paid_usd"),
                    M("attributed_revenue_usd_total").alias("attributed_revenue_usd"),
                    ratio("attributed_revenue_usd_total", "coop_paid_usd_total", 2).alias("revenue_per_coop_dollar"))


@register("q_attributed_by_fy", q("""
SELECT fiscal_year, CAST(sum(attributed_revenue_usd) AS DECIMAL(18,2)) AS attributed_revenue_usd
FROM activity_lift GROUP BY fiscal_year"""))
def q_attributed_by_fy(spark, sf_dir):
    r = metrics.query(_m(spark, sf_dir), "activity_lift", ["fiscal_year"], ["attributed_revenue_usd_total"])
    return r.select("fiscal_year", M("attributed_revenue_usd_total").alias("attributed_revenue_usd"))
