"""Silver layer: conformed, typed, rule-checked tables.

Each function is DataFrame -> DataFrame; nothing is materialized here.  Rule
checks come from ``operators.quality`` so the same rule set drives the drop
(``apply_rules``), the quarantine split and the pass/fail metrics.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import fiscal
from fundlake.operators import quality
from fundlake.sources.domain import Domain

# Calendar spine span used by the tests (covers every driver date).
CALENDAR_START = "1994-03-01"
CALENDAR_END = "2003-02-28"

CLAIM_COLUMNS = ["claim_id", "dealer_id", "program_id", "activity_type_id", "preapproval_id",
                 "submission_date", "requested_amount_usd", "approved_amount_usd", "paid_amount_usd",
                 "status", "brand_compliance_score", "reviewer_id", "decision_date", "payment_date",
                 "claim_doc_uri", "fiscal_year"]


def conform_claims(raw: DataFrame) -> DataFrame:
    """rename/cast to the silver claim schema; fiscal year re-derived from the date."""
    return raw.select(
        "claim_id", "dealer_id", "program_id", "activity_type_id", "preapproval_id", "submission_date",
        F.col("requested_amount_usd").cast("decimal(12,2)").alias("requested_amount_usd"),
        F.col("approved_amount_usd").cast("decimal(12,2)").alias("approved_amount_usd"),
        F.col("paid_amount_usd").cast("decimal(12,2)").alias("paid_amount_usd"),
        "status",
        F.col("brand_compliance_score").cast("int").alias("brand_compliance_score"),
        F.lit(None).cast("string").alias("reviewer_id"),
        "decision_date", "payment_date",
        F.lit(None).cast("string").alias("claim_doc_uri"),
        fiscal.fiscal_year("submission_date").alias("fiscal_year"))


def conform_allocations(raw: DataFrame) -> DataFrame:
    return raw.select("allocation_id", "dealer_id", "program_id", fiscal.fy_label("fy").alias("fiscal_year"),
                      "allocated_usd", "allocation_date", "expiration_date", "allocation_source")


def conform_orders(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat_ws("-", "order_id", F.col("line_no").cast("string"), "line_key").alias("order_line_id"),
                      "order_id", "line_no", "dealer_id", "product_family", "order_date", "ship_date",
                      "net_revenue_usd", fiscal.fiscal_year("order_date").alias("fiscal_year"))


class Silver:
    """Silver tables over one driver directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, domain: Domain | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.dom = domain or Domain(spark, sf_dir)

    # ---------------------------------------------------------------- dims
    @cached_property
    def region(self) -> DataFrame:
        return self.dom.dim_region.select("region_id", "region", "sub_region", "region_full", "default_currency")

    @cached_property
    def dealer(self) -> DataFrame:
        """Current dealer rows (SCD-2 shape; full history is ``operators.history``)."""
        d = self.dom.dealer
        return quality.apply_rules(
            d.select("dealer_id", F.col("account_id").alias("salesforce_account_id"), "dealer_name",
                     "region_id", "country", "tier", "sales_rep_id",
                     F.lit("1995-01-01").cast("date").alias("effective_from"),
                     F.lit(None).cast("date").alias("effective_to"),
                     F.lit(True).alias("is_current")),
            quality.DEALER_RULES)

    @cached_property
    def dim_dealer(self) -> DataFrame:
        """Current-only dealer view with region attributes (snowflake flattened)."""
        return (self.dealer.filter("is_current")
                .join(F.broadcast(self.region), "region_id", "left"))

    @cached_property
    def program(self) -> DataFrame:
        return self.dom.program.drop("fy")

    @cached_property
    def activity_type(self) -> DataFrame:
        return self.dom.activity_type.drop("activity_no")

    def fiscal_calendar(self, start: str = CALENDAR_START, end: str = CALENDAR_END) -> DataFrame:
        return fiscal.calendar(self.spark, start, end)

    def fiscal_calendar_from_data(self) -> DataFrame:
        """A11 spine spanning every fiscal year present in the claim feed (bounds are
        scalar subqueries, so the spine is generated in one task of bounded size)."""
        fys = self.dom.fiscal_years
        b = fys.agg(F.struct(F.min("fy").alias("lo"), F.max("fy").alias("hi"))).scalar()
        lo = F.make_date(b.getField("lo"), F.lit(3), F.lit(1))
        hi = F.date_sub(F.make_date(b.getField("hi") + 1, F.lit(3), F.lit(1)), 1)
        return fiscal.calendar(self.spark, lo, hi)

    # --------------------------------------------------------------- facts
    @cached_property
    def coop_claim(self) -> DataFrame:
        return quality.apply_rules(conform_claims(self.dom.coop_claim), quality.CLAIM_RULES)

    @cached_property
    def coop_allocation(self) -> DataFrame:
        return quality.apply_rules(conform_allocations(self.dom.coop_allocation), quality.ALLOCATION_RULES)

    @cached_property
    def sell_through_order(self) -> DataFrame:
        return quality.apply_rules(conform_orders(self.dom.sell_through_order), quality.ORDER_RULES)

    @cached_property
    def marketing_event(self) -> DataFrame:
        e = self.dom.marketing_event
        return e.select("event_id", "dealer_id", "activity_type_id", "start_date", "end_date", "attendees",
                        F.lit(None).cast("decimal(12,2)").alias("event_cost_usd"),
                        F.lit(None).cast("string").alias("claim_id_nullable"),
                        fiscal.fiscal_year("start_date").alias("fiscal_year"))
