"""Model: the silver + gold tables of one driver directory at one snapshot date.

Everything is a lazy DataFrame; building a Model runs nothing.  A query reads only
what its plan references, so the metric registry joins dimension tables only when
a requested dimension needs them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.plans import gold
from fundlake.plans.oracle import AS_OF, HORIZON
from fundlake.plans.silver import Silver


TABLES_CONF = "fundlake.tables"


class TableSilver:
    """Silver tables read back from a refresh folder (same attribute names as ``Silver``)."""

    def __init__(self, spark: SparkSession, root: str, computed: Silver):
        self.spark = spark
        self.root = root
        self._computed = computed
        self.dom = computed.dom

    def _t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/silver/{name}")

    def __getattr__(self, name: str):
        if name in ("dealer", "program", "activity_type", "region", "coop_allocation", "coop_claim",
                    "sell_through_order", "marketing_event"):
            return self._t(name)
        if name == "dim_dealer":
            return self._t("dealer").filter("is_current").join(self._t("region"), "region_id", "left")
        if name == "fiscal_calendar_from_data":
            return lambda: self._t("fiscal_calendar")
        return getattr(self._computed, name)


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF, horizon_days: int = HORIZON,
                 tables: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.horizon_days = horizon_days
        self.tables = tables
        computed = Silver(spark, sf_dir)
        self.silver = TableSilver(spark, tables, computed) if tables else computed
        self.dom = computed.dom

    @classmethod
    def for_session(cls, spark: SparkSession, sf_dir: str, **kw) -> "Model":
        """Serving mode when the session names a refresh folder (``fundlake.tables``): silver
        and gold are read from the written, partitioned tables; otherwise computed from the
        driver tables."""
        tables = spark.conf.get(TABLES_CONF, None) or None
        return cls(spark, sf_dir, tables=tables, **kw)

    def _gold(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.tables}/gold/{name}")

    def latest_snapshot(self):
        """D6 value: max(date_key) of the utilization source.  The computed source holds
        exactly one snapshot (``as_of``), so the maximum is that literal and the filter
        costs nothing; a table-backed model uses a scalar subquery over its history."""
        if self.tables:
            return self.utilization_history.agg(F.max("date_key")).scalar()
        return F.lit(self.as_of).cast("date")

    # gold facts
    @cached_property
    def utilization_history(self) -> DataFrame:
        """All snapshots: a refresh folder keeps one a day, the computed source has one."""
        return self._gold("fact_coop_utilization_daily") if self.tables else self.utilization

    @cached_property
    def utilization(self) -> DataFrame:
        """The latest snapshot."""
        if self.tables:
            return self.utilization_history.filter(F.col("date_key") == self.latest_snapshot())
        return gold.utilization(self.silver.coop_allocation, self.silver.coop_claim, self.as_of, self.horizon_days)

    @cached_property
    def claim_sla(self) -> DataFrame:
        if self.tables:
            return self._gold("fact_claim_sla")
        return gold.claim_sla(self.silver.coop_claim, self.silver.dealer)

    @cached_property
    def dealer_performance(self) -> DataFrame:
        if self.tables:
            return self._gold("fact_dealer_performance_monthly")
        return gold.dealer_performance_monthly(self.silver.sell_through_order, self.silver.coop_claim,
                                               self.silver.dealer)

    @cached_property
    def activity_lift(self) -> DataFrame:
        if self.tables:
            return self._gold("fact_activity_lift")
        return gold.activity_lift(self.silver.coop_claim, self.silver.dealer, self.silver.activity_type)

    # gold dimension views
    @cached_property
    def dim_dealer(self) -> DataFrame:
        """Current-only dealer rows (no region attributes: those come through dim_region)."""
        return self.silver.dealer.filter("is_current")

    @cached_property
    def dealer_flat(self) -> DataFrame:
        """Current dealer rows with region attributes flattened in."""
        return self.silver.dim_dealer

    @cached_property
    def dim_region(self) -> DataFrame:
        return self.silver.region

    @cached_property
    def dim_program(self) -> DataFrame:
        return self.silver.program

    @cached_property
    def dim_activity_type(self) -> DataFrame:
        return self.silver.activity_type

    @cached_property
    def dim_fiscal_calendar(self) -> DataFrame:
        """K2: every day of the fiscal years in the claim feed, whatever they are."""
        return self.silver.fiscal_calendar_from_data()
