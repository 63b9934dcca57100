"""Rule engine for drop rules, validators, metrics and quarantine.

A rule set is an ordered ``{name: SQL boolean expression}``.  A row passes a rule
when the expression is TRUE (NULL counts as a failure, like a CHECK constraint
evaluated for a drop rule).  All operations are single-pass projections or one
global aggregate; nothing is collected except the bounded per-rule counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The program's drop rules and CHECK constraints.
CLAIM_RULES = {
    "claim_amount_positive": "requested_amount_usd > 0",
    "status_valid": "status IN ('Draft','Submitted','Under_Review','Approved','Rejected','Paid','Expired')",
    "paid_le_approved": "paid_amount_usd IS NULL OR approved_amount_usd IS NULL "
                        "OR paid_amount_usd <= approved_amount_usd",
}
CLAIM_STREAM_RULES = dict(CLAIM_RULES, dealer_not_null="dealer_id IS NOT NULL")
ALLOCATION_RULES = {
    "alloc_amount_positive": "allocated_usd > 0",
    "alloc_dates_ordered": "expiration_date >= allocation_date",
}
ORDER_RULES = {"order_amount_nonneg": "net_revenue_usd >= 0"}
DEALER_RULES = {"tier_valid": "tier IN ('Platinum','Gold','Silver','Authorized')"}
# CHECK constraints of the silver tables
CLAIM_CHECKS = {
    "score_range": "brand_compliance_score IS NULL OR brand_compliance_score BETWEEN 0 AND 100",
    "approved_le_requested": "approved_amount_usd IS NULL OR approved_amount_usd <= requested_amount_usd",
}


def rule_column(expr: str) -> Column:
    return F.coalesce(F.expr(expr), F.lit(False))


def not_null_rules(schema: T.StructType, columns: list[str]) -> dict[str, str]:
    """Generated NOT NULL validators for the named columns."""
    return {f"{c}_not_null": f"`{c}` IS NOT NULL" for c in columns if c in schema.fieldNames()}


def apply_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Keep rows that pass every rule (expect-or-drop)."""
    cond = None
    for expr in rules.values():
        c = rule_column(expr)
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def tag_failures(df: DataFrame, rules: dict[str, str], col_name: str = "failed_rules") -> DataFrame:
    """One projection that lists the names of failed rules per row."""
    checks = [F.when(~rule_column(e), F.lit(n)) for n, e in rules.items()]
    return df.withColumn(col_name, F.filter(F.array(*checks), lambda x: x.isNotNull()))


def split_quarantine(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with ``failed_rules`` and ``reason``)."""
    tagged = tag_failures(df, rules)
    clean = tagged.filter(F.size("failed_rules") == 0).drop("failed_rules")
    bad = (tagged.filter(F.size("failed_rules") > 0)
           .withColumn("reason", F.array_join("failed_rules", ",")))
    return clean, bad


def rule_metrics(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule with passed / failed counts from a single aggregate pass."""
    aggs = []
    for n, e in rules.items():
        aggs.append(F.sum(F.when(rule_column(e), 1).otherwise(0)).cast("bigint").alias(f"p__{n}"))
        aggs.append(F.sum(F.when(rule_column(e), 0).otherwise(1)).cast("bigint").alias(f"f__{n}"))
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule_name"), F.coalesce(F.col(f"p__{n}"), F.lit(0).cast("bigint")).alias("passed"),
                 F.coalesce(F.col(f"f__{n}"), F.lit(0).cast("bigint")).alias("failed"))
        for n in rules])).alias("r")
    return wide.select(stack).select("r.rule_name", "r.passed", "r.failed")


def preflight_nonempty(tables: dict[str, DataFrame]) -> list[str]:
    """Names of empty inputs (each check reads at most one row)."""
    return [name for name, df in tables.items() if df.limit(1).isEmpty()]


def preflight(tables: dict[str, DataFrame]) -> DataFrame:
    """D13 as rows: table_name and is_empty of each input; a check reads one row at most."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(1)).limit(1).agg(F.lit(name).alias("table_name"), (F.count(F.lit(1)) == 0).alias("is_empty"))
        for name, df in tables.items()])


def orphans(fact: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Fact rows whose key is missing from the dimension (anti join)."""
    keys = [key] if isinstance(key, str) else key
    return fact.join(dim.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def repeats(df: DataFrame, key: list[str], totals: list[str] = ()) -> DataFrame:
    """One row a key with ``n_copies``, how many it came in; ``n_copies - 1`` of them are quarantined.  ``total_c``
    sums column c over all copies.  The row kept is the least by its other columns.  An aggregate that combines before the shuffle, so a key that came very
    often stays small; null keys are one key."""
    rest = [c for c in df.columns if c not in key]
    least = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row"), F.count(F.lit(1)).alias("n_copies"),
                                   *[F.sum(c).alias(f"total_{c}") for c in totals])
    return least.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns], "n_copies",
                        *[f"total_{c}" for c in totals])


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str,
              left_name: str = "source", right_name: str = "target") -> DataFrame:
    """Per-key totals on both sides, full outer, rows whose difference is not zero."""
    lt = left.groupBy(*keys).agg(F.sum(value).alias(f"{left_name}_total"))
    rt = right.groupBy(*keys).agg(F.sum(value).alias(f"{right_name}_total"))
    j = lt.join(rt, keys, "full_outer")
    zero = F.lit(0).cast(j.schema[f"{left_name}_total"].dataType)
    diff = F.coalesce(F.col(f"{left_name}_total"), zero) - F.coalesce(F.col(f"{right_name}_total"), zero)
    return j.withColumn("difference", diff).filter(F.col("difference") != 0)
