"""Registered queries: workflow tables, governance scopes and program rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import exact, fiscal, money
from fundlake.functions.exact import ratio_sql
from fundlake.operators import governance, quality, rules, windows, workflow
from fundlake.plans.catalog import FY, REGION_ID
from fundlake.plans.model import Model
from fundlake.plans.oracle import AS_OF, q
from fundlake.sources.domain import dealer_key
from fundlake.sources.driver import read_table

REGISTRY: dict = {}
M = exact.money

# Derived users and campaign template.
USER_ROLES = ["director", "channel_mgr", "rmd", "finance", "dealer"]  # by user index % 5
CAMPAIGN_TEMPLATE = "Q4-Fast-Track-Digital"
CAMPAIGN_OWNER = "U-1"
PRIOR_FY = "FY00"
TERMINAL = "('Approved','Rejected','PaidStaged')"


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _m(spark: SparkSession, sf_dir: str) -> Model:
    return Model.for_session(spark, sf_dir)


def _sd(num, den, scale=2, mult=1):
    return ratio_sql(num, den, scale, mult, "duckdb")


def _k(claim_id_col: str = "claim_id"):
    return F.substring(F.col(claim_id_col), 4, 32).cast("bigint")


# ------------------------------------------------------------------- shared frames
def reviews(m: Model) -> DataFrame:
    return workflow.review_queue(m.silver.coop_claim)


def decisions(m: Model) -> DataFrame:
    c = m.silver.coop_claim.withColumn("k", _k())
    return (c.filter((F.col("k") % 10).isin(0, 1))
            .select("claim_id", F.when(F.col("k") % 10 == 0, F.lit("Approve")).otherwise(F.lit("Reject")).alias("decision"),
                    F.date_add("submission_date", 5).cast("timestamp").alias("decided_at"),
                    F.concat(F.lit("U-"), (F.col("k") % 10).cast("string")).alias("user_id")))


def users(spark: SparkSession, m: Model, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("i")).distinct()
    reg = F.broadcast(m.dom.dim_region.select("region_id", "n_nationkey"))
    role = None
    for idx, r in enumerate(USER_ROLES):
        role = F.when(F.col("i") % 5 == idx, F.lit(r)) if role is None else role.when(F.col("i") % 5 == idx, F.lit(r))
    u = conv.join(reg, (F.col("i") * 3) % 25 == F.col("n_nationkey"), "left").withColumn("role", role)
    return u.select(F.concat(F.lit("U-"), F.col("i").cast("string")).alias("user_id"), "role",
                    F.when(F.col("role").isin("channel_mgr", "rmd"), F.col("region_id")).alias("region_id"),
                    F.when(F.col("role") == "dealer",
                           dealer_key(F.col("i") * 7)).alias("dealer_id"))


_WF_SQL = """reviews AS (
  SELECT claim_id, dealer_id,
         CASE WHEN status IN ('Submitted','Under_Review') THEN 'Pending' WHEN status = 'Approved' THEN 'Approved'
              WHEN status = 'Rejected' THEN 'Rejected' WHEN status = 'Paid' THEN 'PaidStaged' END AS status,
         requested_amount_usd, CAST(submission_date AS TIMESTAMP) AS created_at,
         CAST(decision_date AS TIMESTAMP) AS decision_at,
         coalesce(CAST(decision_date AS TIMESTAMP), CAST(submission_date AS TIMESTAMP)) AS updated_at
  FROM s_claim WHERE status IN ('Submitted','Under_Review','Approved','Rejected','Paid')),
dec AS (
  SELECT claim_id, CASE WHEN k % 10 = 0 THEN 'Approve' ELSE 'Reject' END AS decision,
         CAST(submission_date + 5 AS TIMESTAMP) AS decided_at
  FROM (SELECT *, CAST(substr(claim_id, 4) AS BIGINT) AS k FROM s_claim) c WHERE k % 10 IN (0, 1)),
outcomes AS (
  SELECT d.claim_id, r.status AS old_status,
         CASE WHEN r.status IS NULL THEN NULL WHEN r.status IN """ + TERMINAL + """ THEN r.status
              WHEN d.decision = 'Approve' THEN 'Approved' ELSE 'Rejected' END AS new_status,
         coalesce(r.status IN """ + TERMINAL + """, false) AS was_idempotent,
         r.status IS NOT NULL AND NOT coalesce(r.status IN """ + TERMINAL + """, false) AS applied,
         d.decided_at
  FROM dec d LEFT JOIN reviews r ON d.claim_id = r.claim_id),
reviews2 AS (
  SELECT r.claim_id, r.dealer_id, CASE WHEN o.applied THEN o.new_status ELSE r.status END AS status,
         r.requested_amount_usd, r.created_at
  FROM reviews r LEFT JOIN outcomes o ON r.claim_id = o.claim_id)"""

_USERS_SQL = """users AS (
  SELECT 'U-' || cast(i AS string) AS user_id, role,
         CASE WHEN role IN ('channel_mgr','rmd') THEN region_id END AS region_id,
         CASE WHEN role = 'dealer' THEN 'D-' || printf('%06d', i * 7) END AS dealer_id
  FROM (SELECT i, CASE i % 5 WHEN 0 THEN 'director' WHEN 1 THEN 'channel_mgr' WHEN 2 THEN 'rmd' WHEN 3 THEN 'finance'
                            ELSE 'dealer' END AS role
        FROM (SELECT DISTINCT conv_id % 10 AS i FROM conversations) x) u
  LEFT JOIN dim_region r ON r.n_nationkey = (u.i * 3) % 25)"""


# ------------------------------------------------------------------------ workflow
@register("workflow_review_queue", q("""
SELECT claim_id, dealer_id, status, requested_amount_usd, created_at, decision_at, updated_at FROM reviews""", _WF_SQL))
def workflow_review_queue(spark, sf_dir):
    """claim_review rows mirrored from the claim feed."""
    return reviews(_m(spark, sf_dir))


@register("workflow_apply_decisions", q("""
SELECT claim_id, old_status, new_status, was_idempotent, applied FROM outcomes""", _WF_SQL))
def workflow_apply_decisions(spark, sf_dir):
    """Guarded review update; decisions on terminal reviews are idempotent no-ops."""
    m = _m(spark, sf_dir)
    o = workflow.apply_decisions(reviews(m), decisions(m))
    return o.select("claim_id", "old_status", "new_status", "was_idempotent", "applied")


@register("workflow_effective_status", q("""
SELECT effective_status, count(*) AS n_claims FROM (
  SELECT CASE WHEN r.status = 'Approved' THEN 'Approved' WHEN r.status = 'Rejected' THEN 'Rejected'
              WHEN r.status = 'PaidStaged' THEN 'Paid' ELSE c.status END AS effective_status
  FROM s_claim c LEFT JOIN reviews2 r ON c.claim_id = r.claim_id) x GROUP BY 1""", _WF_SQL))
def workflow_effective_status(spark, sf_dir):
    """B7 + B13 / E19: next review version (upsert, latest wins) fed back onto claim status."""
    m = _m(spark, sf_dir)
    rv = reviews(m)
    nxt = workflow.next_reviews(rv, workflow.apply_decisions(rv, decisions(m)))
    e = workflow.effective_status(m.silver.coop_claim, nxt)
    return e.groupBy("effective_status").agg(F.count(F.lit(1)).alias("n_claims"))


@register("workflow_pending_queue", q(f"""
SELECT r.claim_id, d.dealer_name, r.requested_amount_usd, r.created_at
FROM reviews2 r LEFT JOIN s_dealer d ON r.dealer_id = d.dealer_id
WHERE r.status = 'Pending' AND d.region_id = '{REGION_ID}'
ORDER BY r.created_at, r.claim_id LIMIT 50""", _WF_SQL))
def workflow_pending_queue(spark, sf_dir):
    """Pending reviews with dealer name, region-scoped, first 50 by age."""
    m = _m(spark, sf_dir)
    rv = reviews(m)
    nxt = workflow.next_reviews(rv, workflow.apply_decisions(rv, decisions(m)))
    j = nxt.filter(F.col("status") == "Pending").join(m.dim_dealer.select("dealer_id", "dealer_name", "region_id"),
                                                        "dealer_id", "left")
    return (j.filter(F.col("region_id") == REGION_ID)
            .select("claim_id", "dealer_name", "requested_amount_usd", "created_at")
            .orderBy("created_at", "claim_id").limit(50))


_GAP_SQL = f"""gap AS (
  SELECT u.dealer_id, d.region_id, CAST(substr(u.dealer_id, 3) AS BIGINT) AS custkey,
         CAST(greatest(sum(u.allocated_usd) * CAST(0.92 AS DECIMAL(3,2)) - sum(u.paid_usd), 0) AS DECIMAL(18,2)) AS gap_usd
  FROM util u JOIN s_dealer d ON u.dealer_id = d.dealer_id
  WHERE u.fiscal_year = '{FY}' GROUP BY u.dealer_id, d.region_id
  HAVING greatest(sum(u.allocated_usd) * CAST(0.92 AS DECIMAL(3,2)) - sum(u.paid_usd), 0) > 0),
campaigns AS (
  SELECT region_id, count(*) AS recipient_count,
         sha256(concat_ws('|', '{CAMPAIGN_OWNER}', region_id, cast(count(*) AS string), cast(sum(custkey) AS string),
                          '{CAMPAIGN_TEMPLATE}', '{AS_OF}')) AS call_hash
  FROM gap GROUP BY region_id)"""


def _gap_dealers(m: Model) -> DataFrame:
    u = m.utilization.filter(F.col("fiscal_year") == FY).groupBy("dealer_id").agg(
        F.sum("allocated_usd").alias("a"), F.sum("paid_usd").alias("p"))
    gap = M(money.floor_zero(F.col("a") * F.lit("0.92").cast("decimal(3,2)") - F.col("p")))
    g = u.select("dealer_id", gap.alias("gap_usd")).filter(F.col("gap_usd") > 0)
    return g.join(m.dim_dealer.select("dealer_id", "region_id"), "dealer_id")


def _campaigns(m: Model) -> DataFrame:
    g = _gap_dealers(m).withColumn("custkey", F.substring("dealer_id", 3, 32).cast("bigint"))
    c = g.groupBy("region_id").agg(F.count(F.lit(1)).alias("recipient_count"), F.sum("custkey").alias("s"))
    h = F.sha2(F.concat_ws("|", F.lit(CAMPAIGN_OWNER), F.col("region_id"), F.col("recipient_count").cast("string"),
                           F.col("s").cast("string"), F.lit(CAMPAIGN_TEMPLATE), F.lit(AS_OF)), 256)
    return c.select("region_id", "recipient_count", h.alias("call_hash"))


@register("workflow_campaigns", q(f"""
SELECT c.region_id, 'nudge-' || strftime(DATE '{AS_OF}', '%Y%m') || '-' || substr(c.call_hash, 1, 6) AS campaign_code,
       count(g.dealer_id) AS recipient_count
FROM campaigns c LEFT JOIN gap g ON c.region_id = g.region_id GROUP BY 1, 2""", _GAP_SQL))
def workflow_campaigns(spark, sf_dir):
    """One nudge campaign per region for dealers below target,
    with its code and recipient count (correlated count as left join + aggregate)."""
    m = _m(spark, sf_dir)
    c = _campaigns(m).withColumn("campaign_code",
                                 workflow.campaign_code(F.lit(AS_OF).cast("date"), F.col("call_hash")))
    r = _gap_dealers(m).select("region_id", "dealer_id")
    return (c.join(r, "region_id", "left").groupBy("region_id", "campaign_code")
            .agg(F.count("dealer_id").alias("recipient_count")))


@register("workflow_new_recipients", q(f"""
SELECT count(*) AS n_existing,
       (SELECT count(*) FROM gap n WHERE NOT EXISTS (SELECT 1 FROM old_gap o WHERE o.dealer_id = n.dealer_id)) AS n_inserted
FROM old_gap""", _GAP_SQL + f""",
old_gap AS (SELECT u.dealer_id FROM util u WHERE u.fiscal_year = '{PRIOR_FY}' GROUP BY u.dealer_id
            HAVING greatest(sum(u.allocated_usd) * CAST(0.92 AS DECIMAL(3,2)) - sum(u.paid_usd), 0) > 0)"""))
def workflow_new_recipients(spark, sf_dir):
    """Recipients of the prior-year list stay; only dealers not on it are inserted."""
    m = _m(spark, sf_dir)
    u = m.utilization.filter(F.col("fiscal_year") == PRIOR_FY).groupBy("dealer_id").agg(
        F.sum("allocated_usd").alias("a"), F.sum("paid_usd").alias("p"))
    old = u.filter(money.floor_zero(F.col("a") * F.lit("0.92").cast("decimal(3,2)") - F.col("p")) > 0).select("dealer_id")
    new = _gap_dealers(m).select("dealer_id")
    merged = workflow.insert_if_absent(old, new, ["dealer_id"])
    n_old = old.agg(F.count(F.lit(1))).scalar()
    return merged.agg((F.count(F.lit(1)) - n_old).alias("n_inserted")).select(n_old.alias("n_existing"), "n_inserted")


@register("workflow_cohort_pending", q(f"""
SELECT count(DISTINCT r.dealer_id) AS n_dealers, count(*) AS n_pending,
       CAST(sum(r.requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd
FROM reviews2 r
WHERE r.status = 'Pending' AND r.dealer_id IN (
  SELECT dealer_id FROM util WHERE fiscal_year = '{FY}' AND days_to_expiration BETWEEN 0 AND 179
     AND paid_usd < CAST(0.6 AS DECIMAL(2,1)) * greatest(allocated_usd, 1))""", _WF_SQL))
def workflow_cohort_pending(spark, sf_dir):
    """At-risk cohort dealers that also have pending reviews (semi join)."""
    m = _m(spark, sf_dir)
    u = m.utilization.filter((F.col("fiscal_year") == FY) & F.col("days_to_expiration").between(0, m.horizon_days - 1)
                             & money.under_utilization("paid_usd", "allocated_usd")).select("dealer_id")
    rv = reviews(m)
    nxt = workflow.next_reviews(rv, workflow.apply_decisions(rv, decisions(m)))
    p = nxt.filter(F.col("status") == "Pending").join(u, "dealer_id", "left_semi")
    return p.agg(F.countDistinct("dealer_id").alias("n_dealers"), F.count(F.lit(1)).alias("n_pending"),
                 M(F.sum("requested_amount_usd")).alias("requested_usd"))


@register("workflow_region_tiles", q("""
SELECT d.region_id, count(DISTINCT d.dealer_id) AS n_dealers, count(r.claim_id) AS n_pending
FROM s_dealer d LEFT JOIN (SELECT * FROM reviews2 WHERE status = 'Pending') r ON d.dealer_id = r.dealer_id
GROUP BY d.region_id""", _WF_SQL))
def workflow_region_tiles(spark, sf_dir):
    """dealers and pending reviews per region."""
    m = _m(spark, sf_dir)
    rv = reviews(m)
    nxt = workflow.next_reviews(rv, workflow.apply_decisions(rv, decisions(m)))
    p = nxt.filter(F.col("status") == "Pending").select("dealer_id", "claim_id")
    j = m.dim_dealer.select("dealer_id", "region_id").join(p, "dealer_id", "left")
    return j.groupBy("region_id").agg(F.countDistinct("dealer_id").alias("n_dealers"),
                                      F.count("claim_id").alias("n_pending"))


@register("workflow_audit_rows", q(f"""
SELECT action, target_type, count(*) AS n_rows FROM (
  SELECT 'advance_claim' AS action, 'claim' AS target_type FROM outcomes
  UNION ALL SELECT 'create_nudge_campaign', 'nudge_campaign' FROM (SELECT region_id FROM campaigns) c) x
GROUP BY 1, 2""", _WF_SQL + ",\n" + _GAP_SQL))
def workflow_audit_rows(spark, sf_dir):
    """Append-only audit rows for every tool action (decisions and campaigns)."""
    m = _m(spark, sf_dir)
    o = workflow.apply_decisions(reviews(m), decisions(m))
    a1 = o.select(F.lit("advance_claim").alias("action"), F.lit("claim").alias("target_type"),
                  F.col("claim_id").alias("target_id"),
                  F.to_json(F.struct("old_status", "new_status", "was_idempotent")).alias("payload_json"))
    c = _campaigns(m)
    a2 = c.select(F.lit("create_nudge_campaign").alias("action"), F.lit("nudge_campaign").alias("target_type"),
                  F.col("region_id").alias("target_id"), F.to_json(F.struct("call_hash", "recipient_count"))
                  .alias("payload_json"))
    audit = a1.unionByName(a2)
    return audit.groupBy("action", "target_type").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------------- governance
@register("governance_scoped_totals", q(f"""
SELECT u.user_id, u.role, CASE WHEN u.role IN ('director','finance') THEN 'global'
                               WHEN u.role IN ('channel_mgr','rmd') THEN 'region' ELSE 'dealer' END AS scope,
       CAST(sum(f.unused_usd) AS DECIMAL(18,2)) AS unused_usd, CAST(sum(f.allocated_usd) AS DECIMAL(18,2)) AS allocated_usd,
       CAST(sum(f.paid_usd) AS DECIMAL(18,2)) AS paid_usd
FROM users u LEFT JOIN (SELECT x.*, d.region_id FROM util x JOIN s_dealer d ON x.dealer_id = d.dealer_id
                        WHERE x.fiscal_year = '{FY}') f
  ON (u.role IN ('director','finance')) OR (u.role IN ('channel_mgr','rmd') AND f.region_id = u.region_id)
     OR (u.role = 'dealer' AND f.dealer_id = u.dealer_id)
GROUP BY 1, 2, 3""", _USERS_SQL))
def governance_scoped_totals(spark, sf_dir):
    """M1 / M3: each user's scope (global / region / own dealer) applied before aggregation."""
    m = _m(spark, sf_dir)
    f = (m.utilization.filter(F.col("fiscal_year") == FY)
         .join(m.dim_dealer.select("dealer_id", "region_id"), "dealer_id"))
    t = governance.scoped_totals(users(spark, m, sf_dir), f, ["unused_usd", "allocated_usd", "paid_usd"])
    return t.select("user_id", "role", "scope", *[M(c).alias(c) for c in ["unused_usd", "allocated_usd", "paid_usd"]])


@register("governance_masked_dealers", q("""
SELECT u.user_id, d.dealer_id, d.dealer_name,
       CASE WHEN u.role = 'dealer' THEN NULL ELSE d.sales_rep_id END AS sales_rep_id,
       CASE WHEN u.role = 'dealer' THEN NULL ELSE d.salesforce_account_id END AS salesforce_account_id
FROM users u JOIN s_dealer d
  ON (u.role IN ('channel_mgr','rmd') AND d.region_id = u.region_id) OR (u.role = 'dealer' AND d.dealer_id = u.dealer_id)""",
                                         _USERS_SQL))
def governance_masked_dealers(spark, sf_dir):
    """M1 + M2: dealer rows visible to each scoped user, account and rep masked for dealers."""
    m = _m(spark, sf_dir)
    u = users(spark, m, sf_dir)
    d = m.dim_dealer.select("dealer_id", "dealer_name", "region_id", "sales_rep_id", "salesforce_account_id")
    by_region = u.filter(F.col("role").isin("channel_mgr", "rmd")).select("user_id", "role", "region_id").join(
        d, "region_id")
    by_dealer = u.filter(F.col("role") == "dealer").select("user_id", "role", "dealer_id").join(d, "dealer_id")
    cols = ["user_id", "role", "dealer_id", "dealer_name", "sales_rep_id", "salesforce_account_id"]
    vis = by_region.select(*cols).unionByName(by_dealer.select(*cols))
    masked = governance.mask_columns(vis, "role", {"sales_rep_id": ["dealer"], "salesforce_account_id": ["dealer"]})
    return masked.drop("role")


@register("governance_user_rules", q("""
SELECT 'dealer_role_has_dealer' AS rule_name, count_if(coalesce((role = 'dealer') = (dealer_id IS NOT NULL), false)) AS passed,
       count_if(NOT coalesce((role = 'dealer') = (dealer_id IS NOT NULL), false)) AS failed FROM users
UNION ALL
SELECT 'region_role_has_region', count_if(coalesce(role NOT IN ('channel_mgr','rmd') OR region_id IS NOT NULL, false)),
       count_if(NOT coalesce(role NOT IN ('channel_mgr','rmd') OR region_id IS NOT NULL, false)) FROM users""", _USERS_SQL))
def governance_user_rules(spark, sf_dir):
    """M4: role/scope consistency checks on the user table."""
    m = _m(spark, sf_dir)
    return quality.rule_metrics(users(spark, m, sf_dir), governance.USER_RULES)


# ---------------------------------------------------------------------------- rules
_RULES_SQL = """act_rules AS (
  SELECT * FROM (VALUES ('ACT-04', ['Gold','Platinum']), ('ACT-06', ['Platinum','Gold']),
                        ('ACT-10', ['Gold','Platinum']), ('ACT-12', ['Gold','Platinum'])) t(activity_type_id, allowed_tiers)),
cofund AS (
  SELECT 'ACT-' || lpad(cast(i AS string), 2, '0') AS activity_type_id,
         CASE WHEN i IN (7, 8, 13, 14) THEN 60 WHEN i = 21 THEN 40 ELSE 50 END AS cofund_pct
  FROM range(0, 22) r(i)),
cd AS (
  SELECT c.*, d.tier, r.region FROM s_claim c LEFT JOIN s_dealer d ON c.dealer_id = d.dealer_id
  LEFT JOIN dim_region r ON d.region_id = r.region_id),
elig AS (
  SELECT cd.*, (a.allowed_tiers IS NULL OR list_contains(a.allowed_tiers, cd.tier))
               OR (cd.region = 'AMERICA' AND cd.activity_type_id = 'ACT-04' AND cd.tier IN ('Silver','Authorized')
                   AND cd.requested_amount_usd < 2500) AS eligible
  FROM cd LEFT JOIN act_rules a ON cd.activity_type_id = a.activity_type_id)"""


def _claims_with_dealer(m: Model) -> DataFrame:
    d = m.dealer_flat.select("dealer_id", "tier", "region")
    return m.silver.coop_claim.join(d, "dealer_id", "left")


@register("rule_tier_ineligible_claims", q("""
SELECT claim_id, activity_type_id, tier, region FROM elig WHERE NOT coalesce(eligible, false)""", _RULES_SQL))
def rule_tier_ineligible_claims(spark, sf_dir):
    """O1 + O2: claims whose activity is not open to the dealer's tier (regional override applied)."""
    m = _m(spark, sf_dir)
    e = rules.eligibility(_claims_with_dealer(m), rules.activity_rules(spark))
    return e.filter(~F.coalesce(F.col("eligible"), F.lit(False))).select("claim_id", "activity_type_id", "tier", "region")


@register("rule_cofund_by_program", q("""
SELECT c.program_id, CAST(sum(c.requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd,
       CAST(sum(CAST(c.requested_amount_usd * CAST(f.cofund_pct AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS program_share_usd,
       CAST(sum(c.requested_amount_usd - CAST(c.requested_amount_usd * CAST(f.cofund_pct AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS dealer_share_usd
FROM s_claim c LEFT JOIN cofund f ON c.activity_type_id = f.activity_type_id GROUP BY c.program_id""", _RULES_SQL))
def rule_cofund_by_program(spark, sf_dir):
    """O3: program vs dealer share of requested amounts, per program."""
    m = _m(spark, sf_dir)
    s = rules.cofund_split(m.silver.coop_claim, rules.activity_rules(spark))
    return s.groupBy("program_id").agg(M(F.sum("requested_amount_usd")).alias("requested_usd"),
                                       M(F.sum("program_share_usd")).alias("program_share_usd"),
                                       M(F.sum("dealer_share_usd")).alias("dealer_share_usd"))


@register("rule_rejection_codes", q("""
SELECT code, count(*) AS n_claims FROM (
  SELECT CASE WHEN a.requires_preapproval AND e.requested_amount_usd >= a.preapproval_threshold_usd AND e.preapproval_id IS NULL
              THEN 'MISSING_PREAPPROVAL'
              WHEN NOT coalesce(e.eligible, false) THEN 'TIER_INELIGIBLE'
              WHEN e.brand_compliance_score < 50 THEN 'OFF_BRAND'
              WHEN g.n_programs > 1 THEN 'DOUBLE_DIP' ELSE 'OTHER' END AS code
  FROM elig e LEFT JOIN activity_type a ON e.activity_type_id = a.activity_type_id
  LEFT JOIN (SELECT dealer_id, activity_type_id, submission_date, count(DISTINCT program_id) AS n_programs FROM s_claim
             GROUP BY 1, 2, 3) g
    ON e.dealer_id = g.dealer_id AND e.activity_type_id = g.activity_type_id AND e.submission_date = g.submission_date
  WHERE e.status = 'Rejected') x GROUP BY code""", _RULES_SQL))
def rule_rejection_codes(spark, sf_dir):
    """Rejection code of every rejected claim, first matching reason wins."""
    m = _m(spark, sf_dir)
    e = rules.eligibility(_claims_with_dealer(m), rules.activity_rules(spark))
    a = F.broadcast(m.silver.activity_type.select("activity_type_id", "requires_preapproval", "preapproval_threshold_usd"))
    g = (m.silver.coop_claim.groupBy("dealer_id", "activity_type_id", "submission_date")
         .agg(F.countDistinct("program_id").alias("n_programs")))
    j = (e.filter(F.col("status") == "Rejected").join(a, "activity_type_id", "left")
         .join(g, ["dealer_id", "activity_type_id", "submission_date"], "left"))
    missing = (F.col("requires_preapproval") & (F.col("requested_amount_usd") >= F.col("preapproval_threshold_usd"))
               & F.col("preapproval_id").isNull())
    code = rules.rejection_code(F.coalesce(missing, F.lit(False)), ~F.coalesce(F.col("eligible"), F.lit(False)),
                                F.col("brand_compliance_score"), F.lit(False), F.lit(False),
                                F.coalesce(F.col("n_programs") > 1, F.lit(False)))
    return j.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_claims"))


@register("rule_brand_bands", q("""
SELECT brand_band, count(*) AS n_claims FROM (
  SELECT CASE WHEN s >= 85 THEN 'Approved' WHEN s >= 70 THEN 'Approved with notes'
              WHEN s >= 50 THEN 'Remediation required' ELSE 'Auto-rejected' END AS brand_band
  FROM (SELECT CASE WHEN l * 2 < 20 OR c * 2 < 20 OR t * 2 < 15 OR im * 2 < 20 OR v * 2 < 25
                    THEN least(l + c + t + im + v, 49) ELSE l + c + t + im + v END AS s
        FROM (SELECT brand_compliance_score * 20 // 100 AS l, brand_compliance_score * 20 // 100 AS c,
                     brand_compliance_score * 15 // 100 AS t, brand_compliance_score * 20 // 100 AS im,
                     brand_compliance_score - 3 * (brand_compliance_score * 20 // 100) - brand_compliance_score * 15 // 100 AS v
              FROM s_claim WHERE brand_compliance_score IS NOT NULL) a) b) x
GROUP BY brand_band"""))
def rule_brand_bands(spark, sf_dir):
    """O5 + C24: per-dimension breakdown stored as JSON, parsed back, scored and banded."""
    c = _m(spark, sf_dir).silver.coop_claim.filter(F.col("brand_compliance_score").isNotNull())
    j = c.select(F.to_json(rules.brand_breakdown(F.col("brand_compliance_score"))).alias("brand_check_json"))
    b = j.select(rules.brand_band(F.col("brand_check_json")).alias("b"))
    return b.groupBy(F.col("b.brand_band").alias("brand_band")).agg(F.count(F.lit(1)).alias("n_claims"))


@register("rule_allocation_next_fy", q(f"""
SELECT d.dealer_id, d.tier, CAST(coalesce(r.rev, 0) AS DECIMAL(18,2)) AS prior_revenue_usd,
       CAST(least(CAST(1.25 AS DECIMAL(5,4)),
                  (CASE WHEN coalesce(r.rev, 0) >= coalesce(r2.rev, 0) AND r.rev IS NOT NULL THEN CAST(1.10 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
                * (CASE WHEN s.n > 0 AND s.ssum >= 85 * s.n THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
                * (CASE WHEN s.n_all > 0 AND 4 * s.n_fp >= 3 * s.n_all THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END))
            AS DECIMAL(6,4)) AS multiplier,
       CAST((CASE d.tier WHEN 'Platinum' THEN 200000 WHEN 'Gold' THEN 80000 WHEN 'Silver' THEN 25000 ELSE 8000 END
             + coalesce(r.rev, 0) * CASE d.tier WHEN 'Platinum' THEN CAST(0.015 AS DECIMAL(4,3)) WHEN 'Gold' THEN CAST(0.010 AS DECIMAL(4,3))
                                               WHEN 'Silver' THEN CAST(0.005 AS DECIMAL(4,3)) ELSE CAST(0 AS DECIMAL(4,3)) END)
            * least(CAST(1.25 AS DECIMAL(5,4)),
                  (CASE WHEN coalesce(r.rev, 0) >= coalesce(r2.rev, 0) AND r.rev IS NOT NULL THEN CAST(1.10 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
                * (CASE WHEN s.n > 0 AND s.ssum >= 85 * s.n THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END)
                * (CASE WHEN s.n_all > 0 AND 4 * s.n_fp >= 3 * s.n_all THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END))
            AS DECIMAL(14,2)) AS allocation_usd
FROM s_dealer d
LEFT JOIN (SELECT dealer_id, sum(net_revenue_usd) AS rev FROM s_order WHERE fiscal_year = '{PRIOR_FY}' GROUP BY 1) r ON d.dealer_id = r.dealer_id
LEFT JOIN (SELECT dealer_id, sum(net_revenue_usd) AS rev FROM s_order WHERE fiscal_year = 'FY99' GROUP BY 1) r2 ON d.dealer_id = r2.dealer_id
LEFT JOIN (SELECT dealer_id, count(brand_compliance_score) AS n, sum(brand_compliance_score) AS ssum,
                  count_if(first_pass_approval = TRUE) AS n_fp, count(*) AS n_all
           FROM claim_sla c JOIN (SELECT claim_id, brand_compliance_score FROM s_claim) b USING (claim_id)
           WHERE fiscal_year = '{PRIOR_FY}' GROUP BY 1) s ON d.dealer_id = s.dealer_id"""))
def rule_allocation_next_fy(spark, sf_dir):
    """Next-year allocation = (tier base + % of prior-year sell-in) x performance
    multipliers (target met, brand >= 85, first-pass >= 75%), capped at 1.25."""
    m = _m(spark, sf_dir)
    o = m.silver.sell_through_order
    rev = o.filter(F.col("fiscal_year") == PRIOR_FY).groupBy("dealer_id").agg(F.sum("net_revenue_usd").alias("rev"))
    rev2 = o.filter(F.col("fiscal_year") == "FY99").groupBy("dealer_id").agg(F.sum("net_revenue_usd").alias("rev2"))
    sla = m.claim_sla.filter(F.col("fiscal_year") == PRIOR_FY).join(
        m.silver.coop_claim.select("claim_id", "brand_compliance_score"), "claim_id")
    s = sla.groupBy("dealer_id").agg(F.count("brand_compliance_score").alias("n"),
                                     F.sum("brand_compliance_score").alias("ssum"),
                                     F.count_if(F.col("first_pass_approval") == True).alias("n_fp"),  # noqa: E712
                                     F.count(F.lit(1)).alias("n_all"))
    d = m.dim_dealer.select("dealer_id", "tier").join(rev, "dealer_id", "left").join(rev2, "dealer_id", "left") \
        .join(s, "dealer_id", "left")
    one = F.lit("1").cast("decimal(3,2)")
    z = F.lit(0).cast("decimal(14,2)")
    m1 = F.when((F.coalesce("rev", z) >= F.coalesce("rev2", z)) & F.col("rev").isNotNull(),
                F.lit(rules.MULT_TARGET).cast("decimal(3,2)")).otherwise(one)
    m2 = F.when((F.col("n") > 0) & (F.col("ssum") >= F.col("n") * 85), F.lit(rules.MULT_BRAND).cast("decimal(3,2)")).otherwise(one)
    m3 = F.when((F.col("n_all") > 0) & (F.col("n_fp") * 4 >= F.col("n_all") * 3),
                F.lit(rules.MULT_FIRST_PASS).cast("decimal(3,2)")).otherwise(one)
    mult = F.least(F.lit(rules.MULT_CAP).cast("decimal(5,4)"), m1 * m2 * m3)
    base = None
    pct = None
    for t, v in rules.TIER_BASE.items():
        base = F.when(F.col("tier") == t, F.lit(v)) if base is None else base.when(F.col("tier") == t, F.lit(v))
    for t, v in rules.TIER_SELL_IN_PCT.items():
        c = F.lit(v).cast("decimal(4,3)")
        pct = F.when(F.col("tier") == t, c) if pct is None else pct.when(F.col("tier") == t, c)
    alloc = ((base + F.coalesce("rev", z) * pct) * mult).cast("decimal(14,2)")
    return d.select("dealer_id", "tier", M(F.coalesce("rev", z)).alias("prior_revenue_usd"),
                    mult.cast("decimal(6,4)").alias("multiplier"), alloc.alias("allocation_usd"))


@register("rule_fy_end_outcomes", q("""
SELECT fiscal_year, CASE status WHEN 'Draft' THEN 'forfeit' WHEN 'Submitted' THEN 'protected' WHEN 'Under_Review' THEN 'protected'
                                WHEN 'Approved' THEN 'protected' WHEN 'Paid' THEN 'disbursed' WHEN 'Rejected' THEN 'released'
                                WHEN 'Expired' THEN 'forfeit' END AS outcome,
       count(*) AS n_claims, CAST(sum(requested_amount_usd) AS DECIMAL(18,2)) AS requested_usd
FROM s_claim GROUP BY 1, 2"""))
def rule_fy_end_outcomes(spark, sf_dir):
    """FY-end outcome of every claim by its status."""
    c = _m(spark, sf_dir).silver.coop_claim
    oc = None
    for s, o in rules.FY_END_OUTCOME.items():
        oc = F.when(F.col("status") == s, F.lit(o)) if oc is None else oc.when(F.col("status") == s, F.lit(o))
    return c.groupBy("fiscal_year", oc.alias("outcome")).agg(F.count(F.lit(1)).alias("n_claims"),
                                                             M(F.sum("requested_amount_usd")).alias("requested_usd"))


@register("rule_deadline_flags", q("""
SELECT fiscal_year,
       count_if(submission_date > make_date(fy + 1, 1, 31)) AS late_submissions,
       count_if(decision_date > make_date(fy + 1, 2, 21)) AS late_decisions,
       count_if(payment_date > make_date(fy + 1, 3, 1) - 1) AS payments_after_fy_end
FROM (SELECT *, year(submission_date) - CASE WHEN month(submission_date) < 3 THEN 1 ELSE 0 END AS fy FROM s_claim) c
GROUP BY fiscal_year"""))
def rule_deadline_flags(spark, sf_dir):
    """Submissions after Jan 31, decisions after Feb 21, payments after the FY end."""
    c = _m(spark, sf_dir).silver.coop_claim.withColumn("fy", fiscal.fiscal_year_num("submission_date"))
    sub_dl = F.make_date(F.col("fy") + 1, F.lit(rules.DEADLINE_SUBMIT[0]), F.lit(rules.DEADLINE_SUBMIT[1]))
    dec_dl = F.make_date(F.col("fy") + 1, F.lit(rules.DEADLINE_DECISION[0]), F.lit(rules.DEADLINE_DECISION[1]))
    return c.groupBy("fiscal_year").agg(
        F.count_if(F.col("submission_date") > sub_dl).alias("late_submissions"),
        F.count_if(F.col("decision_date") > dec_dl).alias("late_decisions"),
        F.count_if(F.col("payment_date") > rules.fy_end(F.col("fy"))).alias("payments_after_fy_end"))


@register("rule_extension_candidates", q(f"""
SELECT dealer_id, program_id, unused_usd,
       CAST(least(unused_usd, allocated_usd * CAST(0.30 AS DECIMAL(3,2))) AS DECIMAL(18,2)) AS max_extension_usd,
       make_date(CAST(substr(program_id, 5, 4) AS INTEGER) + 1, 4, 30) AS extended_expiry
FROM util WHERE fiscal_year = '{PRIOR_FY}' AND unused_usd > 0"""))
def rule_extension_candidates(spark, sf_dir):
    """Last year's unused balances with the force-majeure cap (30% of allocation) and
    the extended expiry (April 30 of the following year)."""
    u = _m(spark, sf_dir).utilization.filter((F.col("fiscal_year") == PRIOR_FY) & (F.col("unused_usd") > 0))
    fy = F.substring("program_id", 5, 4).cast("int")
    cap = M(F.least(F.col("unused_usd"), F.col("allocated_usd") * F.lit(rules.FORCE_MAJEURE_CAP).cast("decimal(3,2)")))
    return u.select("dealer_id", "program_id", "unused_usd", cap.alias("max_extension_usd"),
                    F.make_date(fy + 1, F.lit(rules.EXTENSION_EXPIRY[0]), F.lit(rules.EXTENSION_EXPIRY[1]))
                    .alias("extended_expiry"))


_BD_SQL = """bd AS (
  SELECT date_key, sum(CASE WHEN dayofweek(date_key) NOT IN (0, 6) THEN 1 ELSE 0 END) OVER (ORDER BY date_key) AS bd_index
  FROM (SELECT CAST(unnest(generate_series(CAST(make_date(min(fy), 3, 1) AS TIMESTAMP),
                                           CAST(make_date(max(fy) + 1, 3, 1) - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date_key
        FROM fy_list) s)"""


@register("rule_sla_breaches", q(f"""
SELECT c.fiscal_year, count(*) AS n_claims,
       count_if(b2.bd_index - b1.bd_index > {rules.SLA_REVIEW_BD}) AS review_breaches,
       count_if(b3.bd_index - b2.bd_index > {rules.SLA_FINANCE_BD}) AS finance_breaches
FROM s_claim c LEFT JOIN bd b1 ON c.submission_date = b1.date_key LEFT JOIN bd b2 ON c.decision_date = b2.date_key
LEFT JOIN bd b3 ON c.payment_date = b3.date_key
GROUP BY c.fiscal_year""", _BD_SQL))
def rule_sla_breaches(spark, sf_dir):
    """Business-day SLA breaches (review 3+5 days, finance 10 days) per fiscal year."""
    m = _m(spark, sf_dir)
    idx = fiscal.business_day_index(m.silver.fiscal_calendar_from_data())
    c = m.silver.coop_claim
    c = rules.business_days_between(c, idx, "submission_date", "decision_date", "review_bd")
    c = rules.business_days_between(c, idx, "decision_date", "payment_date", "finance_bd")
    return c.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n_claims"),
                                        F.count_if(F.col("review_bd") > rules.SLA_REVIEW_BD).alias("review_breaches"),
                                        F.count_if(F.col("finance_bd") > rules.SLA_FINANCE_BD).alias("finance_breaches"))


@register("rule_reallocation_pairs", q(f"""
WITH_U AS (SELECT 1)
SELECT d.region, d.tier, d.pair_rank, d.dealer_id AS donor_dealer_id, r.dealer_id AS receiver_dealer_id,
       CAST(least(d.amount, r.amount) AS DECIMAL(18,2)) AS transfer_usd
FROM (SELECT *, row_number() OVER (PARTITION BY region, tier ORDER BY amount DESC, dealer_id) AS pair_rank FROM (
        SELECT g.region, dd.tier, u.dealer_id, sum(u.unused_usd) AS amount
        FROM util u JOIN s_dealer dd ON u.dealer_id = dd.dealer_id JOIN dim_region g ON dd.region_id = g.region_id
        WHERE u.fiscal_year = '{FY}' GROUP BY 1, 2, 3
        HAVING sum(u.paid_usd) < CAST(0.4 AS DECIMAL(2,1)) * sum(u.allocated_usd) AND sum(u.unused_usd) > 0) a) d
JOIN (SELECT *, row_number() OVER (PARTITION BY region, tier ORDER BY amount DESC, dealer_id) AS pair_rank FROM (
        SELECT g.region, dd.tier, u.dealer_id, sum(u.committed_usd) - sum(u.allocated_usd) AS amount
        FROM util u JOIN s_dealer dd ON u.dealer_id = dd.dealer_id JOIN dim_region g ON dd.region_id = g.region_id
        WHERE u.fiscal_year = '{FY}' GROUP BY 1, 2, 3 HAVING sum(u.committed_usd) > sum(u.allocated_usd)) b) r
  ON d.region = r.region AND d.tier = r.tier AND d.pair_rank = r.pair_rank""".replace("WITH_U AS (SELECT 1)\n", "")))
def rule_reallocation_pairs(spark, sf_dir):
    """Under-spenders paired with over-committed dealers of the same region and tier."""
    m = _m(spark, sf_dir)
    u = (m.utilization.filter(F.col("fiscal_year") == FY)
         .groupBy("dealer_id").agg(F.sum("unused_usd").alias("unused"), F.sum("paid_usd").alias("paid"),
                                   F.sum("allocated_usd").alias("alloc"), F.sum("committed_usd").alias("committed"))
         .join(m.dealer_flat.select("dealer_id", "region", "tier"), "dealer_id"))
    donor = (F.col("paid") < F.lit("0.4").cast("decimal(2,1)") * F.col("alloc")) & (F.col("unused") > 0)
    receiver = F.col("committed") > F.col("alloc")
    p = rules.reallocation_pairs(u, ["region", "tier"], donor, receiver, F.col("unused"),
                                 F.col("committed") - F.col("alloc"))
    return p.select("region", "tier", F.col("pair_rank").cast("bigint").alias("pair_rank"), "donor_dealer_id",
                    "receiver_dealer_id", M("transfer_usd").alias("transfer_usd"))


@register("rule_audit_flags", q("""
SELECT flag_type, count(*) AS n_flags FROM (
  SELECT 'late_cycle_dumping' AS flag_type FROM (
    SELECT dealer_id, fiscal_year FROM s_claim GROUP BY 1, 2
    HAVING count_if(month(submission_date) = 1 AND day(submission_date) >= 25) * 10 > count(*) * 3) a
  UNION ALL
  SELECT 'preapproval_expired_reuse' FROM s_claim c JOIN (
    SELECT preapproval_id, count(*) AS n, min(submission_date) AS f FROM s_claim WHERE preapproval_id IS NOT NULL GROUP BY 1) s
    ON c.preapproval_id = s.preapproval_id WHERE s.n > 1 AND c.submission_date - s.f > 90
  UNION ALL
  SELECT 'claim_density' FROM (
    SELECT dealer_id, sum(n) OVER (PARTITION BY dealer_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS n7
    FROM (SELECT dealer_id, submission_date AS d, count(*) AS n FROM s_claim GROUP BY 1, 2) x) y WHERE n7 > 20) z
GROUP BY flag_type"""))
def rule_audit_flags(spark, sf_dir):
    """Union of audit flags (late-cycle dumping, expired pre-approval reuse, claim density)."""
    c = _m(spark, sf_dir).silver.coop_claim
    in_w = (F.month("submission_date") == 1) & (F.dayofmonth("submission_date") >= 25)
    f1 = (windows.share_in_window(c, ["dealer_id", "fiscal_year"], in_w)
          .filter(F.col("n_window") * 10 > F.col("n_all") * 3).select(F.lit("late_cycle_dumping").alias("flag_type")))
    f2 = (windows.key_reuse(c.select("claim_id", "preapproval_id", "submission_date"), "preapproval_id",
                            "submission_date", 90)
          .filter(F.col("is_reused") & F.col("is_expired_use")).select(F.lit("preapproval_expired_reuse").alias("flag_type")))
    f3 = (windows.rolling_density(c, "dealer_id", "submission_date", 7).filter(F.col("n_7d") > 20)
          .select(F.lit("claim_density").alias("flag_type")))
    return f1.unionByName(f2).unionByName(f3).groupBy("flag_type").agg(F.count(F.lit(1)).alias("n_flags"))
