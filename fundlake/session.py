"""Session construction and shared-folder resolution.

The library never picks a machine-local folder on a cluster: anything that must
survive executor loss (checkpoints, streaming state, lineage cuts) goes under
``spark.checkpoint.dir``.  Only a local-mode session without that setting (tests,
bench) gets a private folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings shared by tests and bench.  Sized for local[N]; on a cluster the
# same keys are set by the deployment (shuffle partitions ~ 2-3x total cores, AQE on).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "fundlake",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    # pandas deprecation chatter from Arrow-batched Python workers
    os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("FUNDLAKE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="fundlake-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def checkpoint_root(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint dir for one job (stream state, table cut)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system it names; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan (an index, a
    statistics table): the work is done once, and the written files cut the
    lineage, so a lost executor recomputes from them rather than from the sources.
    """
    path = checkpoint_root(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
