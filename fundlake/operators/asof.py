"""Windows over a key that one task could not hold.

``lag``, ``lead``, ``row_number`` and ``last(ignorenulls)`` partitioned by a key put a key with a
third of all rows in one task.  Here the rows are range-partitioned on (keys, order), each range is
stamped with its number, and the same window functions run inside (range, keys).  What they lack is
known from the rows next to a range's borders: a carry table holds one row for a range's first key
and one for its last, is completed by windows over at most one row a range, and is joined back (at
most two rows a range, so it is broadcast).  The stamped rows are written under
``spark.checkpoint.dir`` before the carry table and the result read them: both see the same ranges,
and a lost executor reads the files again.

Null keys form a key of their own.  ``order`` must tell the rows of a key apart where the result
depends on it; rows equal in keys and order stand in one range.  Extra columns pass through.  An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.session import materialize

_PART, _ROW, _LAST = "__part", "__row", "__last"


def _ranges(df: DataFrame, keys: list[str], order: list[Column], n_partitions: int | None,
            **within) -> DataFrame:
    """``df`` written with the number of its range, the place of each row among the range's rows of
    its key, a mark on the last of them, and ``within`` (name -> function of the window)."""
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the stamp stands right above the exchange, where the task's number is the range's
    x = df.repartitionByRange(n, *keys, *order).withColumn(_PART, F.spark_partition_id())
    w = Window.partitionBy(_PART, *keys).orderBy(*order)
    return materialize(x.select("*", F.row_number().over(w).cast("long").alias(_ROW),
                                F.lead(F.lit(True)).over(w).isNull().alias(_LAST),
                                *[f(w).alias(name) for name, f in within.items()]), "ranges")


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the last row of each range's first and last key."""
    key = F.struct(*keys)
    ends = rows.groupBy(_PART).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    return (rows.where(F.col(_LAST) | (F.col(_ROW) == 1)).join(F.broadcast(ends), _PART)
            .where(key.eqNullSafe(F.col("__low")) | key.eqNullSafe(F.col("__high"))))


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the carry columns of their range and key; at most two rows a range are broadcast."""
    c = carry.select(F.col(_PART).alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                     *[x for x in carry.columns if x not in (_PART, *keys)])
    same = reduce(Column.__and__, [rows[k].eqNullSafe(c[f"__k{i}"]) for i, k in enumerate(keys)],
                  rows[_PART] == c["__p"])
    return rows.join(F.broadcast(c), same, "left").drop("__p", *[f"__k{i}" for i in range(len(keys))])


def _before(keys: list[str]):
    """The ranges before this one that have rows of the key."""
    return Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys: list[str], order: list, col: str = "pos",
              n_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as column ``col`` (from 1)."""
    rows = _ranges(df, keys, order, n_partitions)
    held = _edges(rows, keys).where(F.col(_LAST)).select(_PART, *keys, F.col(_ROW).alias("__n"))
    carry = held.select(_PART, *keys, F.sum("__n").over(_before(keys)).alias("__off"))
    return _with_carry(rows, carry, keys).select(
        *df.columns, (F.col(_ROW) + F.coalesce("__off", F.lit(0))).alias(col))


def neighbors(df: DataFrame, keys: list[str], order: list, lag_cols: list[str] = (), lead_cols: list[str] = (),
              prev_prefix: str = "prev_", next_prefix: str = "next_", n_partitions: int | None = None) -> DataFrame:
    """``lag(c)`` / ``lead(c)`` over (partition by keys order by order) as ``prev_c`` / ``next_c``."""
    def shifted(f, c):
        return lambda w: f(c).over(w)
    within = {f"__lag{i}": shifted(F.lag, c) for i, c in enumerate(lag_cols)} \
        | {f"__lead{i}": shifted(F.lead, c) for i, c in enumerate(lead_cols)}
    rows = _ranges(df, keys, order, n_partitions, **within)
    # a struct never is null itself, so a carried null differs from no neighbour
    first, last = F.struct(F.lit(1), *lead_cols), F.struct(F.lit(1), *lag_cols)
    held = (_edges(rows, keys).groupBy(_PART, *keys)
            .agg(F.first(F.when(F.col(_ROW) == 1, first), ignorenulls=True).alias("__first"),
                 F.first(F.when(F.col(_LAST), last), ignorenulls=True).alias("__end")))
    w = Window.partitionBy(*keys).orderBy(_PART)
    carry = held.select(_PART, *keys, F.lag("__end").over(w).alias("__before"), F.lead("__first").over(w).alias("__after"))
    prev = [F.when(F.col(_ROW) == 1, F.col(f"__before.{c}")).otherwise(F.col(f"__lag{i}")).alias(prev_prefix + c)
            for i, c in enumerate(lag_cols)]
    after = [F.when(F.col(_LAST), F.col(f"__after.{c}")).otherwise(F.col(f"__lead{i}")).alias(next_prefix + c)
             for i, c in enumerate(lead_cols)]
    return _with_carry(rows, carry, keys).select(*df.columns, *prev, *after)


def _merged(facts: DataFrame, ticks: DataFrame, keys: list[str], order: str, fact_cols: list[str],
            tick_cols: list[str]) -> tuple[DataFrame, list[Column]]:
    """Facts (``__tick`` null) and ticks (their columns and order in ``__tick``) in one table, and its
    order: at equal ``order`` ticks come first, among themselves by their columns."""
    tick = F.struct(F.col(order).alias("__at"), *tick_cols)
    kind = ticks.select(tick.alias("t")).schema["t"].dataType
    f = facts.select(*keys, order, F.struct(F.lit(0).alias("__fact"), *fact_cols).alias("__f"), F.lit(None).cast(kind).alias("__tick"))
    shape = f.schema["__f"].dataType
    t = ticks.select(*keys, order, F.lit(None).cast(shape).alias("__f"), tick.alias("__tick"))
    return f.unionByName(t), [F.asc(order), F.asc(F.col("__tick").isNull()), F.asc("__tick"), F.asc("__f")]


def asof_latest(facts: DataFrame, ticks: DataFrame, key: str, ts: str, fact_cols: list[str],
                tick_cols: list[str], n_partitions: int | None = None) -> DataFrame:
    """Facts with the ``tick_cols`` (and ``tick_ts``) of the latest tick with the same key and
    tick time <= fact time; NULL when no earlier tick exists."""
    u, order = _merged(facts, ticks, [key], ts, fact_cols, tick_cols)
    rows = _ranges(u, [key], order, n_partitions, __seen=lambda w: F.last("__tick", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = _edges(rows, [key]).where(F.col(_LAST)).select(_PART, key, F.col("__seen").alias("__s"))
    carry = held.select(_PART, key, F.last("__s", ignorenulls=True).over(_before([key])).alias("__carried"))
    out = _with_carry(rows.where(F.col("__f").isNotNull()), carry, [key])
    found = out.withColumn("__t", F.coalesce("__seen", "__carried"))
    return found.select(key, ts, *[F.col(f"__f.{c}").alias(c) for c in fact_cols], F.col("__t.__at").alias("tick_ts"),
                        *[F.col(f"__t.{c}").alias(c) for c in tick_cols])


def nearest(facts: DataFrame, ticks: DataFrame, keys: list[str], order: str, fact_cols: list[str],
            tick_cols: list[str], k: int, n_partitions: int | None = None) -> DataFrame:
    """For each fact the last ``k`` ticks of the same keys at or before its ``order`` and the first ``k``
    after it: one row for each fact and tick, with ``tick_offset`` (0 the last at or before, -1 the one
    before it; 1 the first after).

    One pass numbers the ticks of a key and tells each fact how many lie at or before it; the ticks are
    then found by an equi-join on (keys, number), 2k rows a fact."""
    u, by = _merged(facts, ticks, keys, order, fact_cols, tick_cols)
    rows = _ranges(u, keys, by, n_partitions, __seen=lambda w: F.count("__tick").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = _edges(rows, keys).where(F.col(_LAST)).select(_PART, *keys, F.col("__seen").alias("__s"))
    carry = held.select(_PART, *keys, F.sum("__s").over(_before(keys)).alias("__carried"))
    numbered = _with_carry(rows, carry, keys).withColumn("__n", F.col("__seen") + F.coalesce("__carried", F.lit(0)))
    wanted = (numbered.where(F.col("__f").isNotNull())
              .select(*keys, order, "__f", "__n", F.explode(F.sequence(F.lit(1 - k), F.lit(k))).alias("tick_offset"))
              .withColumn("__want", F.col("__n") + F.col("tick_offset")).where("__want > 0"))
    held_ticks = numbered.where(F.col("__f").isNull()).select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__n").alias("__have"), F.col("__tick").alias("__t"))
    same = reduce(Column.__and__, [wanted[c].eqNullSafe(held_ticks[f"__k{i}"]) for i, c in enumerate(keys)],
                  wanted["__want"] == held_ticks["__have"])
    return wanted.join(held_ticks, same).select(
        *keys, order, *[F.col(f"__f.{c}").alias(c) for c in fact_cols], F.col("__t.__at").alias(f"tick_{order}"),
        *[F.col(f"__t.{c}").alias(c) for c in tick_cols], "tick_offset")
