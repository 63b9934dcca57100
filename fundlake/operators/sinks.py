"""Table writes.

* ``coerce_to_schema`` + ``overwrite`` = idempotent overwrite that keeps the target
  schema (cast per field, target column order, extra source columns reported).
* ``coerce_observed`` + ``coercion_rows`` count dropped values and failed casts in the
  pass that writes the table.
* ``save_bucketed`` stores a catalog table in buckets of a key, so joins and groupings
  on that key need no exchange.
* ``publish_version`` writes a mirror beside the one before; readers change over when it is whole.
* ``append_run`` appends under a run id: a retried run replaces its own rows.
* ``write_partitioned`` uses dynamic partition overwrite, so re-running one fiscal
  year replaces only that year's folders.
* ``publish_latest`` keeps only the latest snapshot (scalar-subquery filter) and
  stamps ``synced_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake.session import path_exists


def coerce_to_schema(df: DataFrame, target: T.StructType) -> tuple[DataFrame, list[str]]:
    """Cast to each target field, add missing as typed NULL, drop (and report) extras."""
    have = set(df.columns)
    cols = []
    for f in target.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    dropped = [c for c in df.columns if c not in set(target.fieldNames())]
    return df.select(*cols), dropped


REPORT_SCHEMA = "table_name string, kind string, column_name string, n_values long"


def _col(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def coerce_observed(df: DataFrame, target: T.StructType) -> tuple[DataFrame, Observation]:
    """``coerce_to_schema`` that never fails on a value and counts what it loses.

    A value that cannot become its target type is null and counted, a column the target does not have is
    left out and its values that are not null are counted, a target column the source does not have is
    null in every row.  Names are compared as they are written.  Nulls are no loss; an empty table counts
    zero.  The counts are observed in the stage that writes, whose task results count once a partition
    however often a task is tried; columns of the right type cost nothing.  Read them with
    ``coercion_rows`` after the one write of the returned frame.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    want = set(target.fieldNames())
    cols, counts = [], [F.count(F.lit(1)).alias("rows:")]
    for f in target.fields:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
            counts.append(F.count(F.lit(1)).alias(f"missing:{f.name}"))
        elif have[f.name] == f.dataType:
            c = _col(f.name)
        else:
            c = _col(f.name).try_cast(f.dataType)
            counts.append(F.count(F.when(_col(f.name).isNotNull() & c.isNull(), 1)).alias(f"failed_cast:{f.name}"))
        cols.append(c.alias(f.name))
    counts += [F.count(_col(n)).alias(f"dropped:{n}") for n in have if n not in want]
    seen = Observation()
    return df.observe(seen, *counts).select(*cols), seen


def coercion_rows(table: str, seen: Observation) -> list[tuple[str, str, str | None, int]]:
    """The counts of one written table as rows of ``REPORT_SCHEMA``; a row for each column that was cast, dropped or missing."""
    parts = [(*k.split(":", 1), n) for k, n in seen.get.items()]
    return [(table, kind, column or None, n) for kind, column, n in parts]


def write_report(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """The report of a refresh: a few rows a table."""
    spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int = 16) -> None:
    """A2: store ``df`` as catalog table ``name`` at ``path``, one file for each of ``buckets`` buckets of ``key``.

    A bucket is read by one task, so this is for tables whose rows a key are bounded (a dealer's programs and
    months), not for claims or order lines.  ``buckets`` follows the size of the table: about 256 MB each.
    Give each call a fresh ``path``: readers of an earlier version keep its files.
    """
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", path).mode("overwrite").saveAsTable(name))


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """B2: dynamic partition overwrite (only partitions present in ``df`` are replaced)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only write (audit rows)."""
    df.write.mode("append").format(fmt).save(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """B10 with retries: the rows of one run stand in a folder of their own, so a run tried again replaces
    its rows instead of doubling them; readers see ``run_id`` as a partition column."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def latest_snapshot(df: DataFrame, date_col: str = "date_key") -> DataFrame:
    """Rows of the latest snapshot only (scalar subquery; partition-pruned when
    ``date_col`` is the partition column of the scanned table)."""
    return df.filter(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def publish_latest(df: DataFrame, path: str, date_col: str = "date_key", synced_at: str | None = None) -> DataFrame:
    """Serving mirror of the latest snapshot with ``synced_at``; truncate + load."""
    ts = F.lit(synced_at).cast("timestamp") if synced_at else F.current_timestamp()
    out = latest_snapshot(df, date_col).withColumn("synced_at", ts)
    out.write.mode("overwrite").parquet(path)
    return out


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions under ``path``, ascending (a listing of the folder, no data)."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def publish_version(df: DataFrame, path: str, date_col: str = "date_key", synced_at: str | None = None) -> int:
    """B6 without a moment in which readers find no table: the latest snapshot with ``synced_at`` as one more version
    beside the earlier ones; its number.  A write that fails leaves a folder that no reader takes and the next
    attempt replaces.  One writer at a time."""
    ts = F.lit(synced_at).cast("timestamp") if synced_at else F.current_timestamp()
    version = max(_versions(df.sparkSession, path), default=0) + 1
    latest_snapshot(df, date_col).withColumn("synced_at", ts).write.mode("overwrite").parquet(f"{path}/v{version}")
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version under ``path``; FileNotFoundError where there is none."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{versions[-1]}")
