"""Helpers the operators of this subpackage share: Arrow plumbing, lineage cuts, components.

Conventions that hold for every operator:

* Only the named input columns are selected, so extra columns (whatever their names) are ignored.
* A null text counts as empty unless an operator says otherwise.
* A row is identified by ``(doc_id, md5(text))`` and shown with ``crc32(text)``; rows repeated exactly get equal results, rows
  that share a doc_id but not the text are told apart.  A null doc_id orders after every other id.
* Intermediate tables go to the folder in ``spark.checkpoint.dir`` (see ``fundlake.session``), so a
  lost executor recomputes from written files.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.session import checkpoint_root

LAST = 2**63 - 1  # the order of a null doc_id
SLICE_BYTES = 400_000  # of text that a numpy step works on at once
BATCH_BYTES = 8_000_000  # of an Arrow batch
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the jobs run inside go when each job's result is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back with the same schema."""
    spark, path = df.sparkSession, checkpoint_root(df.sparkSession, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker serves many stages and would keep the most it took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose Arrow batches to Python workers hold at most ``BATCH_BYTES``: a task keeps one in the
    JVM's buffers and one in its worker, whatever the rows' length.  This is set for the session where
    that has Spark's default; another value is left as it is."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") == str(64 << 20):
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def tidy(run):
    """``run``, a function over Arrow batches, that gives memory back when a task is over."""
    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def spare(df: DataFrame, name: str) -> str:
    """A column name made from ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns doc_id, text (null: empty) and ``more``, nothing else."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null last), tag (crc32 of the text), mark (its md5) and text; doc and mark are a row's identity."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
                              F.crc32("text").alias("tag"), marked("text").alias("mark"), "text")


def marked(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row ranges (first, last + 1) of ``batch`` whose texts hold at most ``limit`` bytes each;
    a longer text is a range of its own."""
    ends = np.cumsum(byte_lengths(batch.column(column)))
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, last
        first = last


def byte_lengths(array: pa.Array) -> np.ndarray:
    return np.fromiter((len(x) for x in (array.cast(pa.binary()).to_pylist())), np.int64, len(array)) \
        if array.null_count else np.diff(offsets(array))


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a null-free string array, from its first row's start."""
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a null-free string array and the offsets of its rows in them."""
    at = offsets(array)
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the smallest reachable node.

    Alternating large-star and small-star steps; each step is joins and combinable aggregates, its
    result is written, and the loop ends when a round changes nothing.
    """
    spark = edges.sparkSession
    step = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct(), name)
    seen = None
    while True:
        both = step.union(step.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a")).where("a <> b").distinct()
        step = cut(large, name)
        low = step.groupBy("a").agg(F.min("b").alias("m"))
        small = step.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        step = cut(small.union(low).distinct(), name)
        now = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return step.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(step.select(F.col("b"), F.col("b")).distinct())
