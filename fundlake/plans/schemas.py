"""Declared target schemas of the 9 silver tables and 4 gold facts."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types, in order.
TARGETS = {
    "dealer": "dealer_id string, salesforce_account_id string, dealer_name string, region_id string, country string, "
              "tier string, sales_rep_id string, effective_from date, effective_to date, is_current boolean",
    "program": "program_id string, program_name string, fiscal_year string, allocation_method string, "
               "default_cofund_pct decimal(5,2), program_start date, program_end date",
    "activity_type": "activity_type_id string, activity_name string, category string, requires_preapproval boolean, "
                     "preapproval_threshold_usd decimal(12,2), lift_factor decimal(4,1)",
    "region": "region_id string, region string, sub_region string, region_full string, default_currency string",
    "fiscal_calendar": "date_key date, fiscal_year string, fiscal_period string, fiscal_week int, fiscal_quarter string, "
                       "is_business_day boolean",
    "coop_allocation": "allocation_id string, dealer_id string, program_id string, fiscal_year string, "
                       "allocated_usd decimal(14,2), allocation_date date, expiration_date date, allocation_source string",
    "coop_claim": "claim_id string, dealer_id string, program_id string, activity_type_id string, preapproval_id string, "
                  "submission_date date, requested_amount_usd decimal(12,2), approved_amount_usd decimal(12,2), "
                  "paid_amount_usd decimal(12,2), status string, brand_compliance_score int, reviewer_id string, "
                  "decision_date date, payment_date date, claim_doc_uri string, fiscal_year string",
    "sell_through_order": "order_line_id string, order_id string, line_no int, dealer_id string, product_family string, "
                          "order_date date, ship_date date, net_revenue_usd decimal(14,2), fiscal_year string",
    "marketing_event": "event_id string, dealer_id string, activity_type_id string, start_date date, end_date date, "
                       "attendees int, event_cost_usd decimal(12,2), claim_id_nullable string, fiscal_year string",
    "fact_coop_utilization_daily": "date_key date, dealer_id string, program_id string, fiscal_year string, "
                                   "fiscal_period string, allocated_usd decimal(14,2), committed_usd decimal(14,2), "
                                   "approved_usd decimal(14,2), paid_usd decimal(14,2), unused_usd decimal(14,2), "
                                   "forfeited_usd decimal(14,2), expected_forfeit_usd decimal(14,2), "
                                   "days_to_expiration int, overcommitted_usd decimal(14,2)",
    "fact_claim_sla": "claim_id string, dealer_id string, region_id string, tier string, program_id string, "
                      "activity_type_id string, submission_date date, decision_date date, payment_date date, "
                      "days_submission_to_review int, days_review_to_decision int, days_decision_to_payment int, "
                      "total_cycle_days int, first_pass_approval boolean, final_status string, fiscal_year string, "
                      "days_submission_to_decision int, review_days_exact int",
    "fact_dealer_performance_monthly": "month date, dealer_id string, region_id string, tier string, "
                                       "net_revenue_usd decimal(14,2), coop_paid_usd decimal(12,2), "
                                       "attributed_coop_usd_lift decimal(14,2), lift_vs_control_pct decimal(6,3), "
                                       "fiscal_year string",
    "fact_activity_lift": "activity_type_id string, region_id string, fiscal_year string, coop_paid_usd decimal(14,2), "
                          "attributed_revenue_usd decimal(14,2), revenue_per_coop_dollar decimal(8,2), "
                          "matched_pairs int, lift_methodology_version string",
}


def target(name: str) -> T.StructType:
    return T.StructType.fromDDL(TARGETS[name])
