"""Window and per-group operators.

Skew rules applied throughout
* Top-N per group uses ``row_number`` <= N, which Spark plans as WindowGroupLimit:
  each map task keeps only its local top N per group before the shuffle, so a hot
  group costs N rows in the exchange, not a third of the table.
* Counting windows (density) first pre-aggregate to (entity, day); the range window
  then runs over at most one row per calendar day per entity.
* Per-key statistics that feed a row flag (reuse counts, first-use dates) are
  group aggregates joined back, not unbounded window partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of claim states for the monotonic-progress check.
STATUS_RANK = {"Draft": 0, "Submitted": 1, "Under_Review": 2, "Approved": 3, "Rejected": 3, "Paid": 4}


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """G1 / H6: first ``n`` rows per group under a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def dense_rank_by(df: DataFrame, order: list[Column], group: list[str] | None = None, col: str = "rank") -> DataFrame:
    """Dense rank (optionally within groups); use on aggregated (bounded) inputs."""
    w = Window.partitionBy(*(group or [])).orderBy(*order)
    return df.withColumn(col, F.dense_rank().over(w))


def with_prior(df: DataFrame, key: list[str], order_col: str, value: str, prefix: str = "prior_") -> DataFrame:
    """Previous period's value per key (``lag``)."""
    w = Window.partitionBy(*key).orderBy(order_col)
    return df.withColumn(f"{prefix}{value}", F.lag(value).over(w))


def rolling_density(events: DataFrame, entity: str, date_col: str, days: int = 7) -> DataFrame:
    """Per entity and day, number of events in the trailing ``days`` window.

    Pre-aggregated to (entity, day) so the range window sees one row per active day.
    """
    daily = (events.groupBy(entity, F.col(date_col).alias("day"))
             .agg(F.count(F.lit(1)).alias("n_day")))
    w = Window.partitionBy(entity).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn(f"n_{days}d", F.sum("n_day").over(w))


def share_in_window(df: DataFrame, key: list[str], in_window: Column) -> DataFrame:
    """Per key, rows inside a date window / all rows (one aggregate)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_all"),
                                F.count_if(in_window).alias("n_window"))


def duplicates_across(df: DataFrame, key: list[str], distinct_col: str, order: list[Column],
                      flag_col: str = "is_duplicate") -> DataFrame:
    """Rows of a key filed under more than one ``distinct_col``; the earliest survives."""
    stats = df.groupBy(*key).agg(F.countDistinct(distinct_col).alias("n_distinct"))
    multi = df.join(stats.filter("n_distinct > 1"), key, "left_semi")
    w = Window.partitionBy(*key).orderBy(*order)
    return multi.withColumn("pos", F.row_number().over(w)).withColumn(flag_col, F.col("pos") > 1)


def status_moves(transitions: DataFrame, key: str, ts: str, status: str, tie: str) -> DataFrame:
    """Previous status, rank comparison and dwell time per transition row.

    ``lag``/``lead`` come from ``neighbors`` (range partitions on (key, ts)), so a claim
    with a third of all transitions is still split across tasks."""
    from fundlake.operators.asof import neighbors
    rank = None
    for s, r in STATUS_RANK.items():
        rank = F.when(F.col(status) == s, F.lit(r)) if rank is None else rank.when(F.col(status) == s, F.lit(r))
    x = transitions.withColumn("status_rank", rank)
    y = neighbors(x, [key], [F.asc(ts), F.asc(tie)], [status, "status_rank"], [ts],
                  prev_prefix="__p_", next_prefix="__n_")
    return (y.withColumnRenamed(f"__p_{status}", "prev_status").withColumnRenamed("__p_status_rank", "prev_rank")
            .withColumnRenamed(f"__n_{ts}", "next_ts")
            .withColumn("is_backward", F.col("prev_rank") > F.col("status_rank"))
            .withColumn("dwell_seconds", F.unix_seconds(F.col("next_ts")) - F.unix_seconds(F.col(ts))))


def key_reuse(df: DataFrame, key: str, date_col: str, validity_days: int) -> DataFrame:
    """Uses per key, first use, and whether this use falls outside the validity window."""
    stats = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_uses"), F.min(date_col).alias("first_use_date"))
    j = df.join(stats, key)
    return (j.withColumn("days_since_first_use", F.datediff(F.col(date_col), F.col("first_use_date")))
            .withColumn("is_reused", F.col("n_uses") > 1)
            .withColumn("is_expired_use", F.col("days_since_first_use") > validity_days))


def running_totals(events: DataFrame, key: list[str], day: str, values: list[str]) -> DataFrame:
    """Cumulative sums per key by day (one row per key and active day)."""
    daily = events.groupBy(*key, day).agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(*key, day, *values, *[F.sum(v).over(w).alias(f"cum_{v}") for v in values])


def daily_grid(events: DataFrame, key: list[str], day: str, values: list[str]) -> DataFrame:
    """one row per key and day from the key's first to its last day, with the day's sums (0 without
    events) and the cumulative sums carried forward.  A key's rows are at most its days.

    Sums run over the days with events alone; each such day then fills the days up to the next one, so the grid
    itself is neither exchanged nor sorted.  Null keys match no event: their days stand with 0."""
    daily = events.groupBy(*key, day).agg(*[F.sum(v).alias(v) for v in values]).where(F.col(day).isNotNull())
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    zero = {v: F.lit(0).cast(daily.schema[v].dataType) for v in values}
    held = daily.select(*key, day, *[F.when(known, F.coalesce(F.col(v), zero[v])).otherwise(zero[v]).alias(v) for v in values])
    by_day = Window.partitionBy(*key).orderBy(day)
    w = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = held.select("*", F.coalesce(F.date_sub(F.lead(day).over(by_day), 1), F.col(day)).alias("__until"), *[F.sum(v).over(w).alias(f"cum_{v}") for v in values])
    days = F.posexplode(F.sequence(day, "__until", F.expr("INTERVAL 1 DAY"))).alias("__i", "__day")
    return sums.select(*key, *values, *[f"cum_{v}" for v in values], days).select(
        *key, F.col("__day").alias(day), *[F.when(F.col("__i") == 0, F.col(v)).otherwise(zero[v]).alias(v) for v in values], *[f"cum_{v}" for v in values])


def compacted(turns: DataFrame, session: str, order: list[str], size: str, every: int = 10, fold: int = 6) -> DataFrame:
    """A transcript after rolling compaction: after every ``every``-th turn the oldest ``fold`` rows,
    a summary row among them, become one summary row.  (session, kind, position, n_turns, size).

    A first fold takes ``fold`` turns, each later one the summary and ``fold`` - 1 turns; after f folds the
    summary holds (fold - 1) f + 1 turns and stands at position 0.  Turns are numbered by range partitions,
    so a session with a third of all turns is split; the summary is a combinable aggregate."""
    from fundlake.operators.asof import positions
    rows = positions(turns.select(session, *order, size), [session], [F.asc(c) for c in order], "position")
    folds = rows.groupBy(session).agg(F.floor(F.max("position") / every).alias("folds"))
    held = rows.join(folds, session)
    covered = (F.col("folds") > 0) & (F.col("position") <= (fold - 1) * F.col("folds") + 1)
    kind = F.when(covered, F.lit("summary")).otherwise(F.lit("turn")).alias("kind")
    place = F.when(covered, F.lit(0)).otherwise(F.col("position")).cast("long").alias("position")
    return held.select(session, kind, place, size).groupBy(session, "kind", "position").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(size).cast("long").alias(size))


def grouped_sets(df: DataFrame, sets: list[list[str]], dims: list[str], aggs: list[Column]) -> DataFrame:
    """F16: GROUPING SETS over ``dims`` with ``grouping_id``, one pass."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        *aggs, F.grouping_id().cast("int").alias("grouping_id"))


def subtotals(df: DataFrame, dims: list[str], aggs: list[Column], kind: str = "rollup") -> DataFrame:
    """F16: ROLLUP / CUBE with ``grouping_id``."""
    g = df.rollup(*dims) if kind == "rollup" else df.cube(*dims)
    return g.agg(*aggs, F.grouping_id().cast("int").alias("grouping_id"))
