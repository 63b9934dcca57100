"""Written tables: coercion that counts what it loses, bucketed catalog tables, appends and audit streams that are tried again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from fundlake.operators import governance, quality, sinks
from fundlake.plans import catalog_tables, refresh, schemas
from fundlake.plans.model import Model
from fundlake.streaming import streams
from tools.plan_report import plan_text

TARGET = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("amount", T.DecimalType(6, 2)),
                       T.StructField("day", T.DateType()), T.StructField("note", T.StringType())])


def _coerced(spark, df, path):
    out, seen = sinks.coerce_observed(df, TARGET)
    assert out.schema.simpleString() == TARGET.simpleString()
    sinks.overwrite(out, path)
    return sinks.coercion_rows("t", seen), {r.id: r for r in spark.read.parquet(path).collect()}


def test_coercion_counts_what_it_loses(spark, tmp_path):
    rows = [("1", "12.50", "2024-01-31", "x"), ("2", "12345678.00", "31/01/2024", None), ("3", None, None, "y"), ("4", "n/a", "2024-02-30", "z")]
    df = spark.createDataFrame(rows, "id string, amount string, day string, `odd.na``me` string").repartition(3)
    report, got = _coerced(spark, df, str(tmp_path / "t"))
    assert sorted(report, key=str) == sorted([("t", "rows", None, 4), ("t", "failed_cast", "id", 0), ("t", "failed_cast", "amount", 2),
                                              ("t", "failed_cast", "day", 2), ("t", "missing", "note", 4), ("t", "dropped", "odd.na`me", 3)], key=str)
    assert [str(got[i].amount) for i in (1, 2, 3, 4)] == ["12.50", "None", "None", "None"]
    assert [got[i].day for i in (1, 2, 3, 4)] == [dt.date(2024, 1, 31), None, None, None]
    assert {r.note for r in got.values()} == {None}


@pytest.mark.parametrize("ddl", ["id string, more int", "id int, amount decimal(6,2), day date, note string"])
def test_coercion_of_an_empty_table(spark, tmp_path, ddl):
    report, got = _coerced(spark, spark.createDataFrame([], ddl), str(tmp_path / "t"))
    assert got == {} and {n for *_, n in report} == {0} and ("t", "rows", None, 0) in report


def test_right_types_cost_nothing(spark):
    df = spark.createDataFrame([(1, None, None, "a")], TARGET)
    out, _ = sinks.coerce_observed(df, TARGET)
    assert "try_cast" not in plan_text(out).lower()


def test_refresh_coerces_every_table(spark, tmp_path):
    out = str(tmp_path / "r")
    refresh.refresh(spark, SF_SMALL, out)
    report = spark.read.parquet(f"{out}/report").collect()
    assert {r.table_name for r in report} == set(schemas.TARGETS) and {r.kind for r in report} == {"rows"}
    for layer, names in (("silver", refresh.SILVER_TABLES), ("gold", [t for t in schemas.TARGETS if t.startswith("fact")])):
        for n in names:
            t = spark.read.parquet(f"{out}/{layer}/{n}")
            assert {(f.name, f.dataType) for f in t.schema.fields} == {(f.name, f.dataType) for f in schemas.target(n).fields}
            assert t.count() == next(r.n_values for r in report if r.table_name == n)


def test_catalog_tables_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = catalog_tables.catalog_dealer_balances(spark, SF_SMALL)
        text = plan_text(df)
        assert "SortMergeJoin" in text and "Exchange" not in text
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_catalog_tables_are_replaced_whole(spark):
    m = Model(spark, SF_SMALL)
    names = refresh.publish_catalog(spark, m, "fundlake_test", buckets=4)
    first = spark.read.table(names[0])
    n = first.count()
    refresh.publish_catalog(spark, m, "fundlake_test", buckets=8)
    assert first.count() == n == spark.read.table(names[0]).count() == m.silver.dealer.count()


def test_a_run_tried_again_does_not_double(spark, tmp_path):
    path = str(tmp_path / "audit")
    for run, ids in (("a", [1, 2]), ("b", [3]), ("a", [1, 2]), ("b", [3])):
        sinks.append_run(spark.createDataFrame([(i,) for i in ids], "id int"), path, run)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_audit_stream_after_a_failure(spark, tmp_path):
    rows = [(f"D-{i % 3}", ["pay", "void"][i % 2], dt.datetime(2024, 1, 1 + i), None if i == 4 else i, i // 3) for i in range(9)]
    df = spark.createDataFrame(rows, "actor string, action string, ts timestamp, n int, chunk int")
    src, path, ckpt = str(tmp_path / "src"), str(tmp_path / "audit"), str(tmp_path / "ckpt")
    streams.stage_files(df, src, "chunk", [0, 1, 2])

    def audit():
        return streams.audit_rows(streams.file_stream(spark, src + "/*", df.drop("chunk").schema), "actor", "action", ["n"])
    whole = streams.append_batches(path)

    def breaks(batch, batch_id):
        whole(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost after the write, before the commit")
    with pytest.raises(Exception, match="lost after the write"):
        streams.append_audit(audit(), path, ckpt, breaks)
    assert spark.read.parquet(path).count() == 6
    streams.append_audit(audit(), path, ckpt)
    got = spark.read.parquet(path)
    assert got.count() == got.select("audit_id").distinct().count() == 9
    assert sorted(got.select("payload").distinct().toPandas()["payload"])[-1] == "{}"


def test_order_lines_have_one_key(spark):
    o = Model(spark, SF_SMALL).silver.sell_through_order
    assert o.count() == o.select("order_line_id").distinct().count()
    assert quality.duplicate_keys(o, ["order_id", "line_no"]).count() > 0


def test_repeats_keep_one_row_a_key(spark):
    df = spark.createDataFrame([("a", 5, "x"), ("a", 3, None), ("a", 3, "z"), (None, 1, "n"), (None, 1, "n"), ("b", None, "y")], "k string, v int, w string")
    got = {r.k: (r.v, r.w, r.n_copies, r.total_v) for r in quality.repeats(df, ["k"], ["v"]).collect()}
    assert got == {"a": (3, None, 3, 11), None: (1, "n", 2, 2), "b": (None, "y", 1, None)}
    assert quality.repeats(df.limit(0), ["k"]).collect() == []


def test_readers_see_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "mirror")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    one = spark.createDataFrame([(1, "2024-01-01")], "x int, date_key string")
    two = one.unionByName(spark.createDataFrame([(2, "2024-01-02"), (3, "2024-01-02")], one.schema))
    assert sinks.publish_version(one, path) == 1
    before = sinks.read_published(spark, path)
    two.write.parquet(f"{path}/v2")
    (tmp_path / "mirror" / "v2" / "_SUCCESS").unlink()  # a write that did not end
    assert [r.x for r in sinks.read_published(spark, path).collect()] == [1]
    assert sinks.publish_version(two, path) == 2
    assert sorted(r.x for r in sinks.read_published(spark, path).collect()) == [2, 3]
    assert [r.x for r in before.collect()] == [1]


def test_revenue_shows_to_its_groups(spark):
    df = spark.createDataFrame([(r, 5) for r in ("director", "finance", "dealer", "admin", "guest", None)], "role string, revenue int")
    got = {r.role: r.revenue for r in governance.limit_columns(df, "role", ["revenue"], governance.REVENUE_GROUPS).collect()}
    assert got == {"director": 5, "finance": 5, "dealer": None, "admin": None, "guest": None, None: None}
