"""Plans and operators at sizes beyond one task: what is joined by shuffle, dealt before it grows, written in bounded files."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from fundlake.operators import corpus, proof, windows
from fundlake.plans import catalog_branches
from fundlake.plans.model import Model
from fundlake.sources import files, workbook
from fundlake.sources.domain import Domain
from fundlake.streaming import streams

Q = E.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_proof_files_are_combined_not_broadcast(spark):
    """F2"""
    names = [f"doc{i:03d}" for i in range(130)]  # of three words of bits
    needed = spark.createDataFrame([("A", n) for n in names] + [("B", names[64]), ("B", names[64]), ("B", None)], "activity_type_id string, document string")
    claims = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c2", "B"), ("c3", "B"), (None, "B"), ("c4", "C")], "claim_id string, activity_type_id string")
    files = spark.createDataFrame([("c1", n) for n in names if n not in ("doc003", "doc126")] * 2 + [("c3", names[64]), ("c3", None), (None, names[64]), ("c9", names[0])],
                                  "claim_id string, document string")
    r = proof.completeness(claims, needed, files)
    assert _plan(r).count("BroadcastHashJoin") == 1  # the requirements alone
    got = {x.claim_id: tuple(x)[1:] for x in r.collect()}
    assert got == {"c1": (130, 2, "doc003,doc126"), "c2": (4, 4, ",".join([names[64]] * 4)), "c3": (2, 0, ""),
                   None: (2, 2, ",".join([names[64]] * 2)), "c4": (0, 0, "")}


def test_rejection_reasons_join_claims_by_shuffle(spark):
    """F3"""
    r = Q["rule_rejection_reasons"](spark, SF_SMALL)
    assert _plan(r).count("SortMergeJoin") >= 3  # files, completeness and double filings of the claims


def test_bm25_repeats_neither_postings_nor_weights(spark, monkeypatch):
    """many blocks of queries, no explosion over blocks and no cogroup; texts are dealt to enough tasks."""
    monkeypatch.setattr(corpus, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(corpus, "BLOCK_POSTINGS", 1)
    cut = []
    chunks = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(12)], "doc_id long, text string")
    r = corpus.bm25_top_k(chunks, chunks.selectExpr("doc_id as query_id", "text as query_text"), 2, keys=("doc_id",), text_col="text",
                          materialize=lambda d: cut.append(_plan(d)) or d)
    plan = _plan(r)
    assert plan.count("MapInArrow") == 6 and "CoGroups" not in plan and "sequence(" not in plan
    assert "REPARTITION_BY_NUM" in cut[0] and {x.query_id for x in r.collect()} == set(range(12))


def test_workbooks_are_written_and_read_row_by_row(tmp_path, monkeypatch):
    """F4"""
    path = str(tmp_path / "w.xlsx")
    assert workbook.write_workbook(path, "s", ["a", "b"], ((i, f"<{i}>" if i % 3 else None) for i in range(20_000))) == 20_000
    import tracemalloc
    tracemalloc.start()
    rows = workbook.sheet_rows(path, "s")
    assert next(rows) == ["a", "b"] and sum(1 for _ in rows) == 20_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000
    assert list(workbook.sheet_rows(path, "s"))[4] == ["3"] and list(workbook.sheet_rows(path, "none")) == []


def test_a_full_workbook_is_followed_by_another(spark, tmp_path, monkeypatch):
    """F4"""
    monkeypatch.setattr(workbook, "MAX_ROWS", 10)
    from pyspark.sql.types import LongType, StructField, StructType
    w = workbook._Writer(StructType([StructField("a", LongType())]), {"path": str(tmp_path)})
    assert [len(w.write(iter([(i,) for i in range(n)])).paths) for n in (0, 9, 10, 25)] == [1, 1, 2, 3]
    got = sorted(r[0] for f in tmp_path.glob("*.xlsx") for r in list(workbook.sheet_rows(str(f), "Sheet1"))[1:])
    assert got == sorted(str(i) for n in (9, 10, 25) for i in range(n))


def test_markdown_files_stand_in_few_folders(spark, monkeypatch):
    """F5"""
    import os
    path = catalog_branches.markdown_files(spark, SF_SMALL).removeprefix("file:")
    folders = [d for d in os.listdir(path) if "=" in d]
    n = sum(f.endswith(".txt") for d in folders for f in os.listdir(f"{path}/{d}"))
    assert n == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() and len(folders) <= 8
    twice = catalog_branches.corpus_rows(spark, SF_SMALL).where("doc_id < 5")
    monkeypatch.setattr(catalog_branches, "corpus_rows", lambda *_: twice.unionByName(twice))
    assert files.read_markdown(spark, catalog_branches.markdown_files(spark, SF_SMALL)).count() == 5  # an id is one file


def test_files_of_a_mounted_folder_are_read_folder_by_folder(spark, tmp_path):
    """a task a folder, not a task for some files; both ways of reading and writing give the same files."""
    rows = spark.createDataFrame([(i % 3, f"doc{i}", "\u00e9" * (i % 5) + f"\n{i}") for i in range(60)] + [(0, "a b%20c", "")], "folder int, name string, value string")
    files.write_texts(rows.repartition(4), f"file:{tmp_path}/a")
    files.write_texts(rows.repartition(4), f"file:{tmp_path}/a/../b")
    rows.select("value", "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(f"file:{tmp_path}/c")
    got = files.read_markdown(spark, f"file:{tmp_path}/a")
    assert got.rdd.getNumPartitions() == 3 and "FileScan" not in _plan(got)
    want = sorted(r.value + "\n" for r in rows.collect())
    assert [sorted(r.md for r in files.read_markdown(spark, f"file:{tmp_path}/{d}").collect()) for d in "abc"] == [want] * 3
    listed = spark.read.text(f"file:{tmp_path}/a", wholetext=True).select("value", "_metadata.file_path")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))  # as Spark reads it, the paths too
    alone = files.read_markdown(spark, f"file:{tmp_path}/a/folder=1").collect()
    assert len(alone) == 20 and "FileScan" in _plan(files.read_markdown(spark, f"file:{tmp_path}/a/folder=1"))
    with open(f"{tmp_path}/a/folder=2/odd.txt", "wb") as f:
        f.write(b"\xff\xfe")
    assert got.where("hex(md) = 'FFFE'").count() == 1  # bytes that are no text stay as they are


def test_claims_of_a_batch_share_python_calls(spark, tmp_path, monkeypatch):
    """many claims, one group; a claim that waits too long closes, one without a name is a claim."""
    monkeypatch.setattr(streams, "CLAIM_BUCKETS", 1)
    day = dt.datetime(2024, 1, 1)
    batches = [[(f"c{i}", 0, "Submitted") for i in range(50)] + [(None, 0, "Paid")],
               [("c1", 10, "Approved"), ("c1", 11, "Submitted")], [("c2", 45, "Paid")], [("c2", 46, "odd")]]
    for i, rows in enumerate(batches):
        rows = [(c, day + dt.timedelta(days=d), j, st) for j, (c, d, st) in enumerate(rows)]
        spark.createDataFrame(rows, "claim_id string, ts timestamp, event_id long, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = streams.file_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema)
    log = f"{tmp_path}/log"
    sdf = streams.claim_state_machine(src)
    assert "bucket" in sdf._jdf.queryExecution().analyzed().toString()
    streams.run_available_now(sdf, streams.append_batches(log), f"{tmp_path}/ckpt", "update")
    got = {(r.claim_id, r.opened_ts.day if r.opened_ts.month == 1 else 99): (r.status, r.n_accepted, r.n_rejected, r.closed) for r in streams.latest_updates(
        spark, log, ["claim_id", "opened_ts"], ["claim_id", "opened_ts", "status", "status_rank", "n_accepted", "n_rejected", "last_ts", "closed"]).collect()}
    assert got[None, 1] == ("Paid", 1, 0, True) and got["c1", 1] == ("Approved", 2, 1, True)
    assert got["c2", 1] == ("Submitted", 1, 0, True) and got["c2", 99] == ("Paid", 1, 1, False) and len(got) == 52


def test_allocations_are_dealt_before_they_grow(spark):
    """F10 to F13, F15, F17 to F19"""
    assert "REPARTITION_BY_NUM" in _plan(Domain(spark, SF_SMALL).coop_allocation)


def test_daily_grid_exchanges_only_days_with_events(spark):
    """F16"""
    ev = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1), ("a", dt.date(2024, 1, 4), 2), (None, dt.date(2024, 1, 1), 7), ("b", None, 3)],
                               "k string, day date, v int")
    g = windows.daily_grid(ev, ["k"], "day", ["v"])
    plan = _plan(g)
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")
    assert sorted(((r.k or "", r.day.day, r.v, r.cum_v) for r in g.collect())) == \
        [("", 1, 0, 0), ("a", 1, 1, 1), ("a", 2, 0, 1), ("a", 3, 0, 1), ("a", 4, 2, 3)]


def test_audited_claims_are_dealt_by_number(spark, monkeypatch):
    """F8: few bytes of claims no longer share a task, which then makes and groups all their parts."""
    monkeypatch.setattr(catalog_branches, "CLAIMS_A_TASK", 100, raising=False)
    m = Model(spark, SF_SMALL)
    x = catalog_branches.audited_claims(m)
    parts = x.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct(F.regexp_extract("claim_id", "[0-9]+", 0)).alias("n")).collect()
    claims = m.silver.coop_claim.count()
    assert sum(p.n for p in parts) == claims and len(parts) > 8 and max(p.n for p in parts) < claims / 4
    daily = _plan(windows.rolling_density(x, "dealer_id", "submission_date", 7))
    assert "REPARTITION_BY_NUM" in daily and daily.count("Exchange hashpartitioning(dealer_id") == 2  # claims and dealers, no more for days
