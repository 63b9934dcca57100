"""Registered source/sink round trips: feeds written from the driver-derived tables in
their landing formats (workbook, CSV roster, JSON claims, JSONL eval set) and read
back with the declared-schema readers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake.operators import sinks
from fundlake.plans.model import Model
from fundlake.plans.oracle import q
from fundlake.session import checkpoint_root
from fundlake.sources import files, workbook
from fundlake.sources.driver import read_table

REGISTRY: dict = {}

ALLOCATION_SCHEMA = T.StructType([
    T.StructField("allocation_id", T.StringType()), T.StructField("dealer_id", T.StringType()),
    T.StructField("program_id", T.StringType()), T.StructField("fiscal_year", T.StringType()),
    T.StructField("allocated_usd", T.DecimalType(14, 2)), T.StructField("allocation_date", T.DateType()),
    T.StructField("expiration_date", T.DateType())])
ROSTER_SCHEMA = T.StructType([f for f in ALLOCATION_SCHEMA.fields if f.name != "fiscal_year"])
CLAIM_JSON_SCHEMA = T.StructType([
    T.StructField("claim_id", T.StringType()), T.StructField("dealer_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("requested_amount_usd", T.DecimalType(12, 2)),
    T.StructField("submission_date", T.DateType())])
MALFORMED_EVERY = 1009  # every n-th claim line lands truncated (a broken upload)


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


_ALLOC_COLS = "allocation_id, dealer_id, program_id, fiscal_year, allocated_usd, allocation_date, expiration_date"


@register("source_workbook_allocations", q(f"SELECT {_ALLOC_COLS} FROM s_allocation"))
def source_workbook_allocations(spark: SparkSession, sf_dir: str):
    """A3 + B1: allocations landed as workbooks (one per task), read back one partition per
    (workbook, sheet) with the declared schema, then coerced to the target schema."""
    workbook.register(spark)
    a = Model(spark, sf_dir).silver.coop_allocation.select(*[f.name for f in ALLOCATION_SCHEMA.fields])
    a = a.repartition("dealer_id")  # one workbook per task, written in parallel
    dest = checkpoint_root(spark, "workbooks")
    a.write.format("xlsx").option("path", dest).option("sheet", "allocations").mode("append").save()
    raw = (spark.read.format("xlsx").schema(ALLOCATION_SCHEMA).option("path", f"{dest}/*.xlsx")
           .option("sheet", "allocations").option("headerRows", "1").load())
    out, _dropped = sinks.coerce_to_schema(raw, ALLOCATION_SCHEMA)
    return out


@register("source_csv_roster", q(f"""
SELECT a.allocation_id, a.dealer_id, a.program_id, a.allocated_usd, a.allocation_date, a.expiration_date,
       d.region_id, a.fiscal_year
FROM s_allocation a JOIN s_dealer d ON a.dealer_id = d.dealer_id"""))
def source_csv_roster(spark: SparkSession, sf_dir: str):
    """A6 + B2 + A13: allocation roster as CSV, one folder per region per fiscal year, read
    back with a pinned schema; region and year come from the folder names."""
    m = Model(spark, sf_dir)
    a = m.silver.coop_allocation.join(m.dim_dealer.select("dealer_id", "region_id"), "dealer_id")
    dest = checkpoint_root(spark, "roster-csv")
    (a.select(*[f.name for f in ROSTER_SCHEMA.fields], "region_id", "fiscal_year")
     .write.mode("overwrite").option("header", True).partitionBy("region_id", "fiscal_year").csv(dest))
    r = files.read_csv(spark, f"{dest}/*/*/*.csv", ROSTER_SCHEMA, base_path=dest)
    return r.select(*[f.name for f in ROSTER_SCHEMA.fields], F.col("region_id").cast("string").alias("region_id"),
                    F.col("fiscal_year").cast("string").alias("fiscal_year"))


@register("source_file_listing", q("SELECT DISTINCT fiscal_year, true AS all_nonempty FROM s_allocation"))
def source_file_listing(spark: SparkSession, sf_dir: str):
    """Path-only listing of landed files (no file content read), by year folder."""
    m = Model(spark, sf_dir)
    dest = checkpoint_root(spark, "listing-csv")
    m.silver.coop_allocation.write.mode("overwrite").option("header", True).partitionBy("fiscal_year").csv(dest)
    ls = files.list_files(spark, f"{dest}/*/*.csv")
    return ls.groupBy(F.regexp_extract("path", "fiscal_year=([^/]+)/", 1).alias("fiscal_year")) \
        .agg(F.min(F.col("length") > 0).alias("all_nonempty"))


_DIRTY_JSON_SQL = f"""
SELECT CASE WHEN k % {MALFORMED_EVERY} = 0 THEN NULL ELSE claim_id END AS claim_id,
       CASE WHEN k % {MALFORMED_EVERY} = 0 THEN NULL ELSE status END AS status,
       CASE WHEN k % {MALFORMED_EVERY} = 0 THEN NULL ELSE requested_amount_usd END AS requested_amount_usd,
       k % {MALFORMED_EVERY} = 0 AS is_malformed
FROM dirty"""


def _dirty_sql():
    from fundlake.plans.catalog_ops import DIRTY_SQL
    return q(_DIRTY_JSON_SQL, DIRTY_SQL)


@register("source_json_claims", _dirty_sql())
def source_json_claims(spark: SparkSession, sf_dir: str):
    """A5: claim objects as JSON lines (raw payload kept, malformed lines flagged not dropped)."""
    d = Model(spark, sf_dir).dom.dirty_claims
    js = F.to_json(F.struct(*[F.col(f.name) for f in CLAIM_JSON_SCHEMA.fields]))
    line = F.when(F.col("k") % MALFORMED_EVERY == 0, F.substring(js, 1, 20)).otherwise(js)
    dest = checkpoint_root(spark, "claims-json")
    d.select(line.alias("value")).write.mode("overwrite").text(dest)
    r = files.read_json_payloads(spark, dest, CLAIM_JSON_SCHEMA)
    return r.select("claim_id", "status", "requested_amount_usd", "is_malformed")


_EVAL_ROWS_SQL = """
SELECT conv_id AS session_id, turn AS turn_index,
       CASE WHEN conv_id % 2 = 0 THEN 'policy' ELSE 'metrics' END AS expected_tool, conv_id % 3 = 0 AS must_cite_corpus,
       CASE conv_id % 4 WHEN 0 THEN 'metric' WHEN 1 THEN 'policy' WHEN 2 THEN 'action' ELSE 'refuse' END AS category,
       CASE (conv_id % 10) % 5 WHEN 0 THEN 'director' WHEN 1 THEN 'channel_mgr' WHEN 2 THEN 'rmd' WHEN 3 THEN 'finance'
            ELSE 'dealer' END AS persona,
       CAST(1 AS INTEGER) AS n_messages, length(text) AS content_chars
FROM conversations WHERE role = 'user'"""


@register("source_eval_jsonl", "WITH x AS (SELECT 1)" + _EVAL_ROWS_SQL)
def source_eval_jsonl(spark: SparkSession, sf_dir: str):
    """A10: nested eval rows (messages, expectations, tags) as JSON lines, read back with
    the declared nested schema and flattened."""
    from fundlake.plans.catalog_text import CATEGORIES, ROLES, _pick
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    k = F.col("conv_id")
    rows = c.select(
        k.alias("session_id"), F.col("turn").alias("turn_index"),
        F.struct(F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages")).alias("inputs"),
        F.struct(F.when(k % 2 == 0, F.lit("policy")).otherwise(F.lit("metrics")).alias("expected_tool"),
                 F.array().cast("array<string>").alias("expected_facts"),
                 (k % 3 == 0).alias("must_cite_corpus")).alias("expectations"),
        F.struct(_pick(CATEGORIES, k % 4).alias("category"), _pick(ROLES, (k % 10) % 5).alias("persona")).alias("tags"))
    dest = checkpoint_root(spark, "eval-jsonl")
    rows.write.mode("overwrite").json(dest)
    r = files.read_jsonl(spark, dest, files.EVAL_SCHEMA)
    return r.select("session_id", "turn_index", F.col("expectations.expected_tool").alias("expected_tool"),
                    F.col("expectations.must_cite_corpus").alias("must_cite_corpus"),
                    F.col("tags.category").alias("category"), F.col("tags.persona").alias("persona"),
                    F.size("inputs.messages").alias("n_messages"),
                    F.length(F.col("inputs.messages")[0]["content"]).cast("bigint").alias("content_chars"))
