"""File-format readers with declared schemas.

Every reader pins its schema (no inference) and can add provenance columns from
the hidden ``_metadata`` struct, so the file a row came from survives ingest.
"""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, base_path: str | None = None) -> DataFrame:
    """Header CSV with a declared schema; partition folders become columns."""
    r = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    if base_path:
        r = r.option("basePath", base_path)
    return r.csv(path).withColumn("_source_file", F.col("_metadata.file_path"))


def read_json_payloads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A5: one JSON object per line; parsed PERMISSIVE into the schema, the raw line kept
    as ``raw_payload`` and malformed lines flagged (not dropped)."""
    t = spark.read.text(path)
    parsed = F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE"})
    return t.select(parsed.alias("j"), F.col("value").alias("raw_payload"),
                    F.try_parse_json(F.col("value")).isNull().alias("is_malformed"),
                    F.col("_metadata.file_path").alias("_source_file")).select("j.*", "raw_payload", "is_malformed",
                                                                              "_source_file")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path-only listing (content column pruned, so file bodies are not read)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


READ_BYTES = 8_000_000  # of files that a batch holds
_ESCAPED = r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]"  # in a file's path, as Spark tells it


def mounted(path: str) -> str | None:
    """The folder that a ``file:`` path names, mounted on the driver and all executors; None for another store."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else None


def _visible(names) -> list[str]:
    return sorted(n for n in names if n[0] not in "._")


def write_texts(rows: DataFrame, path: str) -> None:
    """A file a row under ``path``: folder=<folder>/<name>.txt holds ``value`` and a newline; names are distinct in a folder.

    In a mounted folder the tasks write the files themselves and give them their names when they are whole, so a task
    that runs twice leaves the same ones: Hadoop's local files take a process each to set permissions, and a checksum
    file, whose process comes again.  Other stores are written by Spark, a file a record."""
    root = mounted(path)
    if root is None:
        rows.select("value", "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
        return

    def run(batches):
        made = set()
        for batch in batches:
            for folder, name, value in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "value"))):
                to = f"{root}/folder={folder}"
                if folder not in made:
                    os.makedirs(to, exist_ok=True)
                    made.add(folder)
                part = f"{to}/.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(value.encode() + b"\n")
                os.replace(part, f"{to}/{name}.txt")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])
    os.makedirs(root)
    rows.select("folder", "name", "value").mapInArrow(run, "n long").agg(F.sum("n")).first()


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file markdown documents with their path.

    A mounted folder that holds only folders is read folder by folder: a task lists and reads one of them, so neither
    is the driver given every file nor does a task take only as many as Spark's cost of opening a file allows."""
    root = mounted(path)
    found = _visible(os.listdir(root)) if root and not re.search(r"[*?\[{]", root) and os.path.isdir(root) else []
    if not found or not all(os.path.isdir(f"{root}/{n}") for n in found):
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("md"),
                                                            F.col("_metadata.file_path").alias("path"))

    def run(batches):
        held, names, size = [], [], 0

        def flush():
            texts = pa.array(held, pa.large_binary()).view(pa.large_string()).cast(pa.string(), safe=False) if held else pa.array([], pa.string())
            return pa.record_batch([texts, pa.array(names, pa.string())], ["md", "path"])
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for at, below, here in os.walk(folder):
                    below[:] = _visible(below)
                    for n in _visible(here):
                        with open(f"{at}/{n}", "rb") as f:
                            held.append(f.read())
                        names.append("file:" + re.sub(_ESCAPED, lambda x: f"%{ord(x[0]):02X}", f"{at}/{n}"))
                        size += len(held[-1])
                        if size >= READ_BYTES:
                            yield flush()
                            held, names, size = [], [], 0
        if held:
            yield flush()
    folders = spark.createDataFrame([(f"{root}/{n}",) for n in found], "folder string").repartition(len(found))
    return folders.mapInArrow(run, "md string, path string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A10: nested JSON lines with a declared struct/array schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


EVAL_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("turn_index", T.LongType()),
    T.StructField("inputs", T.StructType([T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])),
    T.StructField("expectations", T.StructType([
        T.StructField("expected_tool", T.StringType()),
        T.StructField("expected_facts", T.ArrayType(T.StringType())),
        T.StructField("must_cite_corpus", T.BooleanType())])),
    T.StructField("tags", T.StructType([T.StructField("category", T.StringType()),
                                        T.StructField("persona", T.StringType())]))])
