"""Operator 5, embedding near-duplicates by a pivot-permutation index.

A bounded sample of the distinct vectors serves as pivots, less those with a cosine above ``APART`` to one
kept: a dense group has few pivots, which its members share, and no more than that.  Every vector is described by the ordered
list of its nearest pivots and entered in the inverted list of each.  Two vectors that share
``SHARED`` pivots or more are candidates; they are compared in the list of their first shared pivot,
by cosine in double precision.  A list longer than ``BLOCK`` is cut into blocks and the block pairs are
compared in tasks of their own, so no list is capped.  Links leave a task as counts for each vector and a
forest, never as pairs.

Defined results: equal vectors are one node with a count; a vector that is null, zero, or holds a null or
non-finite component links with nothing and is kept; vectors of other lengths are compared among
themselves; repeated rows are vectors of their own; an empty table gives no rows.  Fitted on a sample:
``PIVOTS`` at most, one for every ``SPREAD`` distinct vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, components, cut

PIVOTS, SPREAD = 4096, 50
NEAREST, SHARED = 8, 2
APART = 0.7
BLOCK = 1024


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _apart(pivots: np.ndarray, most: float) -> np.ndarray:
    """The pivots, in their order, without those of a cosine above ``most`` to an earlier one that stays."""
    far, kept = np.ones(len(pivots), bool), []
    for k in range(len(pivots)):
        if far[k]:
            kept.append(k)
            far &= pivots @ pivots[k] <= most
    return pivots[kept]


def _roots(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least row that it reaches."""
    root = np.full(len(link), -1)
    for k in range(len(link)):
        reached = np.array([k]) if root[k] < 0 else np.zeros(0, np.int64)
        while len(reached):
            root[reached] = k
            reached = np.flatnonzero(link[reached].any(0) & (root < 0))
    return root


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """A vector's rows, one for each of its nearest pivots; near has them in order."""
    def run(batches):
        for batch in batches:
            raw = batch.column("v").to_pylist()
            size = np.array([len(v) for v in raw])
            near: list = [None] * len(raw)
            for width in set(size.tolist()):
                at = np.flatnonzero(size == width)
                p = pivots.get(width)
                if p is None:
                    for k in at:
                        near[k] = [-width]
                    continue
                close = _unit([raw[k] for k in at]) @ p.T
                order = np.argsort(-close, 1, kind="stable")[:, :nearest]
                for k, o in zip(at, order.tolist()):
                    near[k] = o
            yield pa.record_batch([batch.column("id"), batch.column("n"), pa.array(near, pa.list_(pa.int32())), batch.column("v")],
                                  ["id", "n", "near", "v"])
    return run


def _compared(threshold: float, nearest: int, shared: int):
    """One block pair of one pivot's list: (id, links, root)."""
    def run(key, table):
        _, pivot, i, j = (x.as_py() for x in key)
        ids, n, block = (table.column(c).to_numpy() for c in ("id", "n", "block"))
        x = _unit(table.column("v").to_pylist())
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        near = table.column("near").to_pylist()
        code = {p: c for c, p in enumerate(sorted({p for row in near for p in row}))}
        holds = np.zeros((len(ids), len(code)), np.float32)
        for k, row in enumerate(near):
            holds[k, [code[p] for p in row]] = 1
        link &= holds @ holds.T >= min(shared, min(map(len, near)))
        before = holds[:, :code[pivot]]
        link &= before @ before.T == 0  # the pair belongs to the list of its first shared pivot
        if i != j:
            link &= block[:, None] != block
        order = np.argsort(ids)
        root = np.empty(len(ids), np.int64)
        root[order] = ids[order][_roots(link[np.ix_(order, order)])]
        return pa.table({"a": ids, "links": link @ n, "b": root})
    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, pivots: int = PIVOTS, spread: int = SPREAD,
                    nearest: int = NEAREST, shared: int = SHARED, apart: float = APART) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.coalesce(F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("e", F.when(good, F.col("e")))
    distinct = cut(rows.where("e is not null").groupBy("e").agg(F.min("vec").alias("rep"), F.count("*").alias("n"))
                   .select(F.monotonically_increasing_id().alias("id"), "rep", "n", "e"), "pp-vectors")
    many = distinct.count()
    if not many:
        return rows.select(F.expr(f"nullif(vec, {LAST})").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                           F.expr(f"nullif(vec, {LAST})").alias("component_id"), F.lit(True).alias("kept"))
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(max(nearest, min(pivots, many // spread))).select("e").collect()
    by_width: dict[int, list[bytes]] = {}
    for r in sample:
        by_width.setdefault(8 * len(r.e), []).append(np.array(r.e, "<f8").tobytes())
    held = {w: _apart(_unit(v), apart) for w, v in by_width.items()}

    def packed(batches):
        for batch in batches:
            v = batch.column("e")
            raw = [x.values.to_numpy().astype("<f8").tobytes() for x in v]
            yield pa.record_batch([batch.column("id"), batch.column("n"), pa.array(raw, pa.binary())], ["id", "n", "v"])
    described = distinct.select("id", "n", "e").mapInArrow(packed, "id long, n long, v binary") \
        .mapInArrow(_describe(held, nearest), "id long, n long, near array<int>, v binary")
    described = cut(described, "pp-described")
    entered = described.select("id", "n", "near", "v", F.length("v").alias("width"), F.explode("near").alias("pivot"))
    lists = entered.groupBy("width", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = entered.join(lists, ["width", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = dealt.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    met = cut(paired.select("width", "pivot", "i", "j", "id", "n", "near", "v", "block").groupBy("width", "pivot", "i", "j")
              .applyInArrow(_compared(threshold, nearest, shared), "a long, links long, b long").where("links > 0"), "pp-links")
    links = met.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    root = components(met.select("a", "b"), "pp-components")
    least = root.join(distinct.select(F.col("id").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    of_node = distinct.join(links, "id", "left").join(root.join(least, "root").select(F.col("node").alias("id"), "component"), "id", "left") \
        .select("e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_node, "e", "left").select(
        "vec", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component"))
    return out.select(F.expr(f"nullif(vec, {LAST})").alias("vec_id"), "n_links", F.expr(f"nullif(component, {LAST})").alias("component_id"),
                      (F.col("vec") == F.col("component")).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
