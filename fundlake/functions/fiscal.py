"""C6-C8, A11 and business days: fiscal calendar as column expressions.

The fiscal year starts on March 1 and carries its start-year label
(``FY26`` = 2026-03-01 .. 2027-02-28).  All helpers take and return Columns so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fiscal year starts in this month; quarter labels per fiscal month 1..12.
FY_START_MONTH = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year_num(d) -> Column:
    """Start year of the fiscal year containing date ``d`` (NULL stays NULL)."""
    d = _c(d)
    return F.year(d) - F.when(F.month(d) < FY_START_MONTH, F.lit(1)).otherwise(F.lit(0))


def fy_label(fy_num) -> Column:
    """``FY`` + two-digit start year."""
    return F.concat(F.lit("FY"), F.lpad(F.pmod(_c(fy_num), F.lit(100)).cast("string"), 2, "0"))


def fy_number(label) -> Column:
    """Start year of a two-digit label: FY70 to FY99 are 1970 to 1999, FY00 to FY69 are 2000 to 2069."""
    n = F.substring(_c(label), 3, 2).cast("int")
    return n + F.when(n >= 70, F.lit(1900)).otherwise(F.lit(2000))


def fiscal_year(d) -> Column:
    return fy_label(fiscal_year_num(d))


def fiscal_month(d) -> Column:
    """1..12 within the fiscal year (March = 1)."""
    return F.pmod(F.month(_c(d)) - F.lit(FY_START_MONTH), F.lit(12)) + F.lit(1)


def fiscal_period(d) -> Column:
    return F.concat(F.lit("P"), F.lpad(fiscal_month(d).cast("string"), 2, "0"))


def fy_start(d) -> Column:
    return F.make_date(fiscal_year_num(d), F.lit(FY_START_MONTH), F.lit(1))


def fiscal_week(d) -> Column:
    """Days since the fiscal-year start, integer-divided by 7, plus one."""
    return (F.floor(F.datediff(_c(d), fy_start(d)) / F.lit(7)) + F.lit(1)).cast("int")


def fiscal_quarter(d) -> Column:
    return F.concat(F.lit("Q"), (((fiscal_month(d) - F.lit(1)) / F.lit(3)).cast("int") + F.lit(1)).cast("string"))


def calendar(spark: SparkSession, start, end) -> DataFrame:
    """One row per day in [start, end] with fiscal attributes.

    The spine is bounded by the calendar span (a few thousand rows), so it is a
    safe broadcast side for date joins.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(_as_date(start), _as_date(end),
                             F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    return days.select(
        "date_key",
        fiscal_year("date_key").alias("fiscal_year"),
        fiscal_period("date_key").alias("fiscal_period"),
        fiscal_week("date_key").alias("fiscal_week"),
        fiscal_quarter("date_key").alias("fiscal_quarter"),
        (F.dayofweek("date_key").isin(1, 7) == F.lit(False)).alias("is_business_day"),
    )


def _as_date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def business_day_index(cal: DataFrame) -> DataFrame:
    """Prefix count of business days per calendar date (for business-day differences).

    ``bd_index(d2) - bd_index(d1)`` = business days in (d1, d2].  The window runs over
    the bounded calendar spine, never over a fact.
    """
    from pyspark.sql import Window as W
    w = W.orderBy("date_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cal.select("date_key", F.sum(F.col("is_business_day").cast("int")).over(w).alias("bd_index"))


def add_days(d, n) -> Column:
    return F.date_add(_c(d), _c(n) if not isinstance(n, int) else F.lit(n))


def iso_date(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)
