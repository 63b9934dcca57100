"""DuckDB SQL twins of the Spark plans (the correctness oracle).

``base_sql`` is a CTE chain that derives the domain, silver and gold tables from
the pre-registered driver views; each registered query appends its own final
SELECT.  The SQL is written independently of the DataFrame code (plain SQL,
DuckDB dialect: ``//`` for integer division, ``HUGEINT`` cents, dates minus
dates for day counts).
"""

from __future__ import annotations

AS_OF = "2001-10-13"
HORIZON = 180

_BASE = r"""
dim_region AS (
  SELECT concat('RGN-', r_name, '-', cast(n_nationkey AS string)) AS region_id,
         r_name AS region, n_name AS sub_region, concat(r_name, ' ', n_name) AS region_full,
         CAST(NULL AS VARCHAR) AS default_currency, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey),
dealer AS (
  SELECT concat('D-', printf('%06d', c_custkey)) AS dealer_id, c_name AS dealer_name,
         concat('ACC-', cast(c_custkey AS string)) AS account_id, region_id, region, sub_region, region_full,
         sub_region AS country,
         CASE WHEN c_custkey % 20 = 0 THEN 'Platinum' WHEN c_custkey % 20 < 5 THEN 'Gold'
              WHEN c_custkey % 20 < 13 THEN 'Silver' ELSE 'Authorized' END AS tier,
         concat('REP-', cast(100 + c_custkey % 900 AS string)) AS sales_rep_id, c_custkey
  FROM customer JOIN dim_region ON c_nationkey = n_nationkey),
claim_base AS (
  SELECT o_orderkey AS k, o_custkey, cast(o_orderdate AS date) AS submission_date,
         year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END AS fy,
         cast(cast(o_totalprice AS decimal(14,2)) * cast(0.05 AS decimal(4,2)) AS decimal(12,2)) AS requested_amount_usd,
         CASE WHEN o_orderkey % 100 < 5 THEN 'Draft' WHEN o_orderkey % 100 < 13 THEN 'Submitted'
              WHEN o_orderkey % 100 < 25 THEN 'Under_Review' WHEN o_orderkey % 100 < 50 THEN 'Approved'
              WHEN o_orderkey % 100 < 58 THEN 'Rejected' WHEN o_orderkey % 100 < 96 THEN 'Paid'
              ELSE 'Expired' END AS status
  FROM orders),
coop_claim AS (
  SELECT concat('CL-', printf('%08d', k)) AS claim_id,
         concat('D-', printf('%06d', o_custkey)) AS dealer_id,
         concat('PRG-', cast(fy AS string), CASE WHEN o_custkey % 5 = 0 AND k % 3 = 0 THEN '-LAB' ELSE '-MAIN' END) AS program_id,
         concat('ACT-', lpad(cast(k % 22 AS string), 2, '0')) AS activity_type_id,
         CASE WHEN k % 20 <> 0 THEN concat('PA-', cast(k % 5000 AS string)) END AS preapproval_id,
         fy, submission_date, status, requested_amount_usd,
         CASE WHEN status IN ('Approved', 'Paid') THEN cast(requested_amount_usd * cast(85 + k % 16 AS decimal(5,0)) * cast(0.01 AS decimal(3,2)) AS decimal(12,2)) END AS approved_amount_usd,
         CASE WHEN status = 'Paid' THEN cast(requested_amount_usd * cast(80 + k % 6 AS decimal(5,0)) * cast(0.01 AS decimal(3,2)) AS decimal(12,2)) END AS paid_amount_usd,
         CASE WHEN status IN ('Approved', 'Paid') THEN submission_date + cast(3 + k % 19 AS int)
              WHEN status = 'Rejected' THEN submission_date + cast(3 + k % 12 AS int) END AS decision_date,
         CASE WHEN status = 'Paid' THEN submission_date + cast(10 + k % 19 + k % 24 AS int) END AS payment_date,
         CASE WHEN status <> 'Draft' THEN cast(55 + k % 46 AS int) END AS brand_compliance_score,
         k
  FROM claim_base),
activity_type AS (
  SELECT concat('ACT-', lpad(cast(a AS string), 2, '0')) AS activity_type_id, concat('Activity ', cast(a AS string)) AS activity_name,
         CASE a % 5 WHEN 0 THEN 'Digital' WHEN 1 THEN 'Event' WHEN 2 THEN 'Showroom' WHEN 3 THEN 'Content' ELSE 'Sponsorship' END AS category,
         a % 4 <> 3 AS requires_preapproval,
         cast(CASE a % 4 WHEN 0 THEN 0 WHEN 1 THEN 5000 WHEN 2 THEN 2500 END AS decimal(12,2)) AS preapproval_threshold_usd,
         cast(CASE a WHEN 0 THEN 7.4 WHEN 1 THEN 5.1 WHEN 2 THEN 4.2 WHEN 3 THEN 3.8 WHEN 4 THEN 2.9 ELSE 1.8 END AS decimal(4,1)) AS lift_factor
  FROM (SELECT DISTINCT k % 22 AS a FROM claim_base) x),
fy_list AS (SELECT DISTINCT fy FROM claim_base),
coop_allocation AS (
  SELECT concat('AL-', cast(c_custkey AS string), '-', cast(fy AS string), p) AS allocation_id, dealer_id,
         concat('PRG-', cast(fy AS string), p) AS program_id, fy,
         cast(CASE tier WHEN 'Platinum' THEN 200000 WHEN 'Gold' THEN 80000 WHEN 'Silver' THEN 25000 ELSE 8000 END
              * (60 + 10 * ((c_custkey * 7 + fy) % 9)) * cast(0.01 AS decimal(3,2)) AS decimal(14,2)) AS allocated_usd,
         make_date(fy, 3, 1) + cast(c_custkey % 30 AS int) AS allocation_date,
         make_date(fy + 1, 3, 1) - 1 AS expiration_date
  FROM dealer CROSS JOIN fy_list f
       JOIN (SELECT '-MAIN' AS p UNION ALL SELECT '-LAB' AS p) q ON p = '-MAIN' OR c_custkey % 5 = 0),
sell_through_order AS (
  SELECT concat('O-', cast(o_orderkey AS string)) AS order_id, l_linenumber AS line_no,
         concat('D-', printf('%06d', o_custkey)) AS dealer_id,
         CASE l_partkey % 5 WHEN 0 THEN 'Seating' WHEN 1 THEN 'Desks' WHEN 2 THEN 'Storage' WHEN 3 THEN 'Architecture' ELSE 'Accessories' END AS product_family,
         cast(o_orderdate AS date) AS order_date, cast(l_shipdate AS date) AS ship_date,
         cast(cast(l_extendedprice AS decimal(14,2)) * (cast(1 AS decimal(4,2)) - cast(l_discount AS decimal(4,2))) AS decimal(14,2)) AS net_revenue_usd,
         concat_ws('-', l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS line_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s_dealer AS (
  SELECT d.dealer_id, d.account_id AS salesforce_account_id, d.dealer_name, d.region_id, d.country, d.tier,
         d.sales_rep_id, DATE '1995-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to, TRUE AS is_current
  FROM dealer d),
dim_dealer AS (
  SELECT s.*, r.region, r.sub_region, r.region_full, r.default_currency
  FROM s_dealer s LEFT JOIN dim_region r ON s.region_id = r.region_id),
s_claim AS (
  SELECT claim_id, dealer_id, program_id, activity_type_id, preapproval_id, submission_date,
         requested_amount_usd, approved_amount_usd, paid_amount_usd, status, brand_compliance_score,
         CAST(NULL AS VARCHAR) AS reviewer_id, decision_date, payment_date, CAST(NULL AS VARCHAR) AS claim_doc_uri,
         concat('FY', lpad(cast(fy % 100 AS string), 2, '0')) AS fiscal_year
  FROM coop_claim
  WHERE requested_amount_usd > 0
    AND status IN ('Draft','Submitted','Under_Review','Approved','Rejected','Paid','Expired')
    AND (paid_amount_usd IS NULL OR approved_amount_usd IS NULL OR paid_amount_usd <= approved_amount_usd)),
s_allocation AS (
  SELECT allocation_id, dealer_id, program_id, concat('FY', lpad(cast(fy % 100 AS string), 2, '0')) AS fiscal_year,
         allocated_usd, allocation_date, expiration_date,
         CASE WHEN program_id LIKE '%-LAB' THEN 'top_up' ELSE 'initial' END AS allocation_source
  FROM coop_allocation WHERE allocated_usd > 0 AND expiration_date >= allocation_date),
s_order AS (
  SELECT concat_ws('-', order_id, line_no, line_key) AS order_line_id, order_id, line_no, dealer_id, product_family,
         order_date, ship_date, net_revenue_usd,
         concat('FY', lpad(cast((year(order_date) - CASE WHEN month(order_date) < 3 THEN 1 ELSE 0 END) % 100 AS string), 2, '0')) AS fiscal_year
  FROM sell_through_order WHERE net_revenue_usd >= 0),
s_program AS (
  SELECT concat('PRG-', cast(fy AS string), p) AS program_id,
         concat('Co-op ', cast(fy AS string), CASE WHEN p = '-LAB' THEN ' Lab fund' ELSE ' Main fund' END) AS program_name,
         concat('FY', lpad(cast(fy % 100 AS string), 2, '0')) AS fiscal_year,
         CASE WHEN p = '-LAB' THEN 'discretionary' ELSE 'tier_formula' END AS allocation_method,
         CAST(NULL AS DECIMAL(5,2)) AS default_cofund_pct,
         make_date(fy, 3, 1) AS program_start, make_date(fy + 1, 3, 1) - 1 AS program_end
  FROM fy_list CROSS JOIN (SELECT '-MAIN' AS p UNION ALL SELECT '-LAB' AS p) q),
alloc_agg AS (
  SELECT dealer_id, program_id, fiscal_year, sum(allocated_usd) AS allocated_usd, min(expiration_date) AS expiration_date
  FROM s_allocation GROUP BY dealer_id, program_id, fiscal_year),
claim_sums AS (
  SELECT dealer_id, program_id,
         sum(CASE WHEN status IN ('Submitted','Under_Review','Approved','Paid') THEN requested_amount_usd ELSE 0 END) AS committed_usd,
         sum(CASE WHEN status IN ('Approved','Paid') THEN coalesce(approved_amount_usd, 0) ELSE 0 END) AS approved_usd,
         sum(CASE WHEN status = 'Paid' THEN coalesce(paid_amount_usd, 0) ELSE 0 END) AS paid_usd
  FROM s_claim GROUP BY dealer_id, program_id),
util_base AS (
  SELECT a.dealer_id, a.program_id, a.fiscal_year,
         CAST(a.allocated_usd AS DECIMAL(14,2)) AS allocated_usd,
         CAST(coalesce(c.committed_usd, 0) AS DECIMAL(14,2)) AS committed_usd,
         CAST(coalesce(c.approved_usd, 0) AS DECIMAL(14,2)) AS approved_usd,
         CAST(coalesce(c.paid_usd, 0) AS DECIMAL(14,2)) AS paid_usd,
         CAST(a.expiration_date - DATE '{as_of}' AS INTEGER) AS days_to_expiration
  FROM alloc_agg a LEFT JOIN claim_sums c ON a.dealer_id = c.dealer_id AND a.program_id = c.program_id),
util_u AS (
  SELECT *, CAST(greatest(allocated_usd - committed_usd, 0) AS DECIMAL(14,2)) AS unused_usd FROM util_base),
util_c AS (
  SELECT *, CAST(unused_usd * 100 AS HUGEINT) AS u_c, CAST(allocated_usd * 100 AS HUGEINT) AS a_c,
         CAST(least(greatest(paid_usd, 0), allocated_usd) * 100 AS HUGEINT) AS p_c
  FROM util_u),
util AS (
  SELECT DATE '{as_of}' AS date_key, dealer_id, program_id, fiscal_year,
         concat('P', lpad(cast(((month(DATE '{as_of}') + 9) % 12) + 1 AS string), 2, '0')) AS fiscal_period,
         allocated_usd, committed_usd, approved_usd, paid_usd, unused_usd,
         CASE WHEN days_to_expiration < 0 THEN unused_usd ELSE CAST(0 AS DECIMAL(14,2)) END AS forfeited_usd,
         CASE WHEN days_to_expiration < 0 THEN unused_usd
              WHEN days_to_expiration < {horizon} AND paid_usd < CAST(0.6 AS DECIMAL(2,1)) * greatest(allocated_usd, 1) THEN unused_usd
              ELSE CAST(CAST(CASE WHEN a_c > 0 THEN (2 * u_c * (a_c - p_c) * (a_c - p_c) + 10 * a_c * a_c) // (20 * a_c * a_c) END AS DECIMAL(14,0))
                        * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) END AS expected_forfeit_usd,
         days_to_expiration,
         CAST(greatest(committed_usd - allocated_usd, 0) AS DECIMAL(14,2)) AS overcommitted_usd
  FROM util_c),
claim_sla AS (
  SELECT c.claim_id, c.dealer_id, d.region_id, d.tier, c.program_id, c.activity_type_id,
         c.submission_date, c.decision_date, c.payment_date,
         CAST((c.decision_date - c.submission_date) // 2 AS INTEGER) AS days_submission_to_review,
         CAST((c.decision_date - c.submission_date) // 2 AS INTEGER) AS days_review_to_decision,
         CAST(c.payment_date - c.decision_date AS INTEGER) AS days_decision_to_payment,
         CAST(c.payment_date - c.submission_date AS INTEGER) AS total_cycle_days,
         (c.status IN ('Approved','Paid') AND c.brand_compliance_score >= 70) AS first_pass_approval,
         c.status AS final_status, c.fiscal_year,
         CAST(c.decision_date - c.submission_date AS INTEGER) AS days_submission_to_decision,
         CAST((c.decision_date - c.submission_date) - (c.decision_date - c.submission_date) // 2 AS INTEGER) AS review_days_exact
  FROM s_claim c LEFT JOIN s_dealer d ON c.dealer_id = d.dealer_id),
monthly_rev AS (
  SELECT dealer_id, CAST(date_trunc('month', order_date) AS DATE) AS month_start, fiscal_year,
         sum(net_revenue_usd) AS net_revenue_usd
  FROM s_order GROUP BY 1, 2, 3),
monthly_paid AS (
  SELECT dealer_id, CAST(date_trunc('month', payment_date) AS DATE) AS month_start, sum(paid_amount_usd) AS coop_paid_usd
  FROM s_claim WHERE status = 'Paid' GROUP BY 1, 2),
perf AS (
  SELECT r.month_start AS month, r.dealer_id, d.region_id, d.tier,
         CAST(r.net_revenue_usd AS DECIMAL(14,2)) AS net_revenue_usd,
         CAST(coalesce(p.coop_paid_usd, 0) AS DECIMAL(12,2)) AS coop_paid_usd,
         CAST(CAST(coalesce(p.coop_paid_usd, 0) AS DECIMAL(12,2)) * CAST(3.5 AS DECIMAL(2,1)) AS DECIMAL(14,2)) AS attributed_coop_usd_lift,
         CAST(0.06 AS DECIMAL(6,3)) AS lift_vs_control_pct,
         r.fiscal_year
  FROM monthly_rev r LEFT JOIN monthly_paid p ON r.dealer_id = p.dealer_id AND r.month_start = p.month_start
       LEFT JOIN s_dealer d ON r.dealer_id = d.dealer_id),
lift_base AS (
  SELECT c.activity_type_id, d.region_id, c.fiscal_year, sum(c.paid_amount_usd) AS coop_paid_usd, count(*) AS matched_pairs
  FROM s_claim c LEFT JOIN s_dealer d ON c.dealer_id = d.dealer_id
  WHERE c.status = 'Paid' GROUP BY 1, 2, 3),
activity_lift AS (
  SELECT b.activity_type_id, b.region_id, b.fiscal_year,
         CAST(b.coop_paid_usd AS DECIMAL(14,2)) AS coop_paid_usd,
         CAST(CAST(b.coop_paid_usd AS DECIMAL(14,2)) * coalesce(a.lift_factor, CAST(1.8 AS DECIMAL(4,1))) AS DECIMAL(14,2)) AS attributed_revenue_usd,
         CAST(CAST(CAST(b.coop_paid_usd AS DECIMAL(14,2)) * coalesce(a.lift_factor, CAST(1.8 AS DECIMAL(4,1))) AS DECIMAL(14,2))
              / greatest(CAST(b.coop_paid_usd AS DECIMAL(14,2)), 1) AS DECIMAL(8,2)) AS revenue_per_coop_dollar,
         CAST(b.matched_pairs AS INTEGER) AS matched_pairs,
         'v1.0-matched-tier-region' AS lift_methodology_version
  FROM lift_base b LEFT JOIN activity_type a ON b.activity_type_id = a.activity_type_id)
"""


def base_sql(as_of: str = AS_OF, horizon: int = HORIZON) -> str:
    return _BASE.replace("{as_of}", as_of).replace("{horizon}", str(horizon))


def q(final_select: str, extra_ctes: str = "", as_of: str = AS_OF, horizon: int = HORIZON) -> str:
    """Compose one oracle query: base CTEs (+ optional extra CTEs) + final SELECT."""
    ctes = base_sql(as_of, horizon).strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{final_select.strip()}"
