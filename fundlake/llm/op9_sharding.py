"""Operator 9, sharding by Karmarkar-Karp differencing; law ``bytes``.

Equal texts form one indivisible group.  Groups are dealt by hash into buckets of bounded size;
in each bucket the differencing method repeatedly combines the two partial partitions of largest
spread, heaviest part with lightest.  A bucket leaves one partial partition (a tuple of shard sums);
those tuples are the items of the next level, until one tuple is left.  Shards are then read back
down the levels by joins.

Defined results: no rows for an empty table; a null text is a group of its own kind of size 1 that
equals the empty text; repeated rows are members of one group; a null doc_id keeps its row.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, texts

SHARDS = 16
FAN_IN = 2048  # items a bucket holds on average


def difference(items: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions (lists of sums, one for each part).

    Returns the sums of the result, ascending, and for each item the part its own parts went to.
    The parts of a combination are held as lists of (item, part) so nothing is searched for.
    """
    heap = []
    for i, sums in enumerate(items):
        order = sorted(range(len(sums)), key=lambda p: (sums[p], p))
        parts = [(sums[p], [(i, p)] if sums[p] else []) for p in order]
        heap.append((parts[0][0] - parts[-1][0], i, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, x = heapq.heappop(heap)
        _, j, y = heapq.heappop(heap)
        parts = []
        for (a, held), (b, other) in zip(x, reversed(y)):
            long, short = (held, other) if len(held) >= len(other) else (other, held)
            long.extend(short)
            parts.append((a + b, long))
        parts.sort(key=lambda p: p[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], min(i, j), parts))
    width = len(items[0])
    went = [[-1] * width for _ in items]
    parts = heap[0][2]
    for to, (_, held) in enumerate(parts):
        for i, p in held:
            went[i][p] = to
    for row in went:  # parts without bytes take the places that are left
        free = iter(sorted(set(range(width)) - set(row)))
        row[:] = [p if p >= 0 else next(free) for p in row]
    return [s for s, _ in parts], went


def _level(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        sums, went = difference([list(map(int, x)) for x in pdf["sums"]])
        return pd.DataFrame({"item": pdf["item"], "bucket": pdf["bucket"], "went": went,
                             "total": [sums] * len(pdf)})
    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """``groups`` (item string, size long, one row an item) -> (item, shard int)."""
    zero = [F.lit(0).cast("long")] * (shards - 1)
    level = groups.select("item", F.array(*zero, F.col("size").cast("long")).alias("sums"))
    dealt, n = [], groups.count()
    while n:
        buckets = max(1, math.ceil(n / fan_in))
        out = cut(level.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(len(dealt))), F.lit(buckets)))
                  .groupBy("bucket").applyInPandas(_level(shards), "item string, bucket long, went array<int>, total array<long>"),
                  "kk")
        dealt.append(out)
        if buckets == 1:
            break
        level = out.groupBy("bucket").agg(F.first("total").alias("sums")) \
            .select(F.col("bucket").cast("string").alias("item"), "sums")
        n = level.count()
    if not dealt:
        return groups.select("item", F.lit(0).alias("shard"))
    placed = dealt[-1].select("item", "went")
    for out in reversed(dealt[:-1]):
        up = placed.select(F.col("item").alias("up"), F.col("went").alias("above"))
        placed = out.join(up, F.col("bucket").cast("string") == F.col("up")) \
            .select("item", F.transform("went", lambda p: F.get("above", p)).alias("went"))
    return placed.select("item", F.get("went", F.lit(shards - 1)).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    rows = cut(texts(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
                                  F.crc32("text").alias("text_crc32"), F.md5("text").alias("item")), "kk-rows")
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = shard_groups(groups, shards, fan_in)
    cells = max(1, rows.count() // 4096)
    rows = cut(rows.join(placed, "item").withColumn("cell", F.pmod(F.xxhash64("doc_id", "item"), F.lit(cells)).cast("int"))
               .withColumn("shard", F.col("shard").cast("int")), "kk-placed")
    return rows.join(_bases(rows), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.expr("row_number() over (partition by shard, cell order by doc_id, item)") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _bases(rows: DataFrame) -> DataFrame:
    """(shard, cell, base): rows of the shard in earlier cells.  Cells are summed in blocks of 1024
    and blocks before that, so no window holds more than a block's cells or a shard's blocks."""
    count = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("block", F.expr("cell div 1024"))
    block = count.groupBy("shard", "block").agg(F.sum("n").alias("m"))
    block = block.selectExpr("shard", "block", "sum(m) over (partition by shard order by block) - m as before")
    inside = "sum(n) over (partition by shard, block order by cell) - n"
    return count.selectExpr("shard", "cell", "block", f"{inside} as inner").join(block, ["shard", "block"]) \
        .selectExpr("shard", "cell", "before + inner as base")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
