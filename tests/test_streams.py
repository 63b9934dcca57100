"""Stream sinks survive replays: a micro-batch re-run after a failure rewrites its own output."""

from pyspark.sql import functions as F

from fundlake.streaming.streams import append_batches, latest_updates


def test_batch_sink_idempotent_on_replay(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "log")
    sink = append_batches(path)
    sink(df, 0)
    sink(df, 0)  # batch 0 replayed after a failure
    sink(df.withColumn("v", F.col("v") + 10), 1)
    assert spark.read.parquet(path).count() == 4
    latest = {r.k: r.v for r in latest_updates(spark, path, ["k"], ["k", "v"]).collect()}
    assert latest == {"a": 11, "b": 12}


def test_claim_state_goes_when_the_watermark_passes(spark, tmp_path):
    """Two claims, the second hot: a much later transition of a third one lets the watermark pass their end, the
    state of both goes, and their last rows say so.  Batches and Arrow batches of any size give the same rows."""
    import datetime as dt
    from fundlake.streaming.streams import claim_state_machine, file_stream, run_available_now, stage_files
    base = dt.datetime(2024, 1, 1)
    rows = [("c1", base, 1, "Submitted", 0), ("c1", base + dt.timedelta(days=1), 2, "Approved", 0)]
    rows += [("hot", base + dt.timedelta(minutes=k), 10 + k, ["Submitted", "Under_Review", "Submitted", "Paid"][min(k // 100, 3)], k // 200) for k in range(400)]
    rows += [("c1", base + dt.timedelta(days=40), 900, "Submitted", 2), ("c2", base + dt.timedelta(days=90), 901, "Submitted", 3)]
    df = spark.createDataFrame(rows, "claim_id string, ts timestamp, event_id long, status string, chunk int")
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    stage_files(df, src, "chunk", [0, 1, 2, 3])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sdf = claim_state_machine(file_stream(spark, src + "/*", df.drop("chunk").schema), ttl_days=30)
        q = run_available_now(sdf, append_batches(log), str(tmp_path / "ckpt"), "update")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 2 and held[-1] == 1  # of all claims only the latest one keeps a state
    got = {(r.claim_id, r.opened_ts): (r.status, r.n_accepted, r.n_rejected, r.closed) for r in latest_updates(
        spark, log, ["claim_id", "opened_ts"], ["claim_id", "opened_ts", "status", "n_accepted", "n_rejected", "closed"]).collect()}
    assert got == {("c1", base): ("Approved", 2, 0, True), ("hot", base): ("Paid", 300, 100, True),
                   ("c1", base + dt.timedelta(days=40)): ("Submitted", 1, 0, True), ("c2", base + dt.timedelta(days=90)): ("Submitted", 1, 0, False)}


def test_deduplication_state_ends(spark, tmp_path):
    import datetime as dt
    from fundlake.streaming.streams import dedupe_within_watermark, file_stream, run_available_now, stage_files
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=k), f"call{k % 3}", 0) for k in range(9)] + [(50 + c, base + dt.timedelta(days=c), "late", c) for c in (1, 2)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, call string, chunk int")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stage_files(df, src, "chunk", [0, 1, 2], ["ts"])
    d = dedupe_within_watermark(file_stream(spark, src + "/*", df.drop("chunk").schema), "ts", ["call"], "5 minutes")
    q = run_available_now(d, append_batches(out), str(tmp_path / "ckpt"), "append")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 3 and held[-1] <= 1
    assert {r.event_id for r in spark.read.parquet(out).collect()} >= {0, 1, 2, 51}
