"""Structured Streaming jobs.

All jobs use a file source with a declared schema, an ``availableNow`` trigger and
a checkpoint under the shared checkpoint folder, so a restart resumes exactly
where the previous run stopped (exactly-once file ingest, idempotent sinks).

Aggregating jobs write in *update* mode through ``foreachBatch`` as append-only
rows tagged with the batch id; readers take the latest row per key
(``latest_updates``).  That keeps state bounded by the watermark, never rewrites a
table, and makes the sink idempotent on batch replay (rows of a replayed batch id
are identical).
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fundlake.operators import quality
from fundlake.operators.windows import STATUS_RANK
from fundlake.session import checkpoint_root, path_exists


# ------------------------------------------------------------------ source staging
def stage_files(df: DataFrame, dest: str, chunk_col: str, order: list, sort: list[str] = ()) -> list[str]:
    """Write ``df`` as one folder per chunk value, in the given order (one write per chunk,
    so file modification times follow ``order`` and a file source replays them in it);
    ``sort``: the order of the rows in a file."""
    paths = []
    for i, v in enumerate(order):
        p = f"{dest}/chunk-{i:04d}"
        part = df.filter(F.col(chunk_col) == F.lit(v)).drop(chunk_col).coalesce(1)
        (part.sortWithinPartitions(*sort) if sort else part).write.mode("overwrite").parquet(p)
        paths.append(p)
    return paths


def stage_once(df: DataFrame, dest: str) -> str:
    """Write ``df`` to ``dest`` in one pass, for jobs to which the order of the files means nothing."""
    df.write.parquet(dest)
    return dest


def file_stream(spark: SparkSession, path_glob: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """A4: incremental file ingest with a pinned schema (no inference, no evolution)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path_glob))


def with_provenance(df: DataFrame, source_name: str | None = None) -> DataFrame:
    """Ingest timestamp, source file and sheet/feed name."""
    out = df.withColumn("_ingest_ts", F.current_timestamp()).withColumn("_source_file", F.col("_metadata.file_path"))
    if source_name:
        out = out.withColumn("_source_sheet", F.lit(source_name))
    return out


def run_available_now(sdf: DataFrame, sink: Callable | str, checkpoint: str, output_mode: str = "append",
                      path: str | None = None, fmt: str = "parquet"):
    """Start, drain everything available, stop (L1/L4); the ended query, with its progress."""
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True)
    if callable(sink):
        q = w.foreachBatch(sink).start()
    else:
        q = w.format(fmt).start(path)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def batch_path(path: str, batch_id: int) -> str:
    """Folder of one micro-batch; readers see ``_batch_id`` as a partition column."""
    return f"{path}/_batch_id={batch_id}"


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch overwrites its own folder, so a batch replayed after a
    failure replaces its earlier output instead of duplicating it (exactly-once)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(path, batch_id))
    return sink


def audit_rows(sdf: DataFrame, actor: str, action: str, payload: list[str], at: str = "ts") -> DataFrame:
    """One audit row an event: who did what when, the payload as JSON, and an id made from the rest, so
    the row of an event is the same however often it is made."""
    body = F.to_json(F.struct(*payload))
    key = F.concat_ws("\u001f", F.col(actor), F.col(action), F.col(at).cast("string"), body)
    return sdf.select(F.sha2(key, 256).alias("audit_id"), F.col(at).alias("logged_at"), F.col(actor).alias("actor"),
                      F.col(action).alias("action"), body.alias("payload"))


def append_audit(audit: DataFrame, path: str, checkpoint: str, sink: Callable | None = None):
    """A stream of audit rows appended to ``path``, a folder for each batch id.  A batch that is run again
    after a failure rewrites its folder, so no row stands twice; a restart with the same ``checkpoint`` goes on
    with the first batch that was not committed."""
    return run_available_now(audit, sink or append_batches(path), checkpoint)


def latest_updates(spark: SparkSession, path: str, keys: list[str], schema_cols: list[str]) -> DataFrame:
    """Latest update per key from an append-only update log (aggregate, skew-safe)."""
    df = spark.read.parquet(path)
    packed = F.struct(F.col("_batch_id"), *[F.col(c) for c in schema_cols if c not in keys])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("r"))
    return agg.select(*keys, *[F.col(f"r.{c}").alias(c) for c in schema_cols if c not in keys])


# ---------------------------------------------------------------------------- jobs
def ingest_bronze(spark: SparkSession, src_glob: str, schema: T.StructType, dest: str, name: str) -> None:
    """L1: file stream -> bronze parquet with provenance, exactly-once by checkpoint."""
    sdf = with_provenance(file_stream(spark, src_glob, schema), name)
    run_available_now(sdf, "parquet", checkpoint_root(spark, f"ckpt-{name}"), path=dest)


def bronze_to_silver(spark: SparkSession, bronze_glob: str, schema: T.StructType,
                     transform: Callable[[DataFrame], DataFrame], rules: dict[str, str],
                     silver_path: str, quarantine_path: str, name: str, max_files: int = 1) -> None:
    """L2 / L3: stateless conform + drop rules, failing rows to a quarantine table.

    One pass tags the failed rule names; ``foreachBatch`` writes the two sides.
    A replayed batch id overwrites its own folder, so the sink is idempotent.
    """
    sdf = quality.tag_failures(transform(file_stream(spark, bronze_glob, schema, max_files)), rules)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one pass tags rows; both sides overwrite this batch's folders (idempotent replay)
        (batch.filter(F.size("failed_rules") == 0).drop("failed_rules")
         .write.mode("overwrite").parquet(batch_path(silver_path, batch_id)))
        (batch.filter(F.size("failed_rules") > 0).withColumn("reason", F.array_join("failed_rules", ","))
         .drop("failed_rules").write.mode("overwrite").parquet(batch_path(quarantine_path, batch_id)))
    run_available_now(sdf, sink, checkpoint_root(spark, f"ckpt-{name}"))


def windowed_counts(sdf: DataFrame, ts: str, keys: list[str], window: str, slide: str | None = None,
                    watermark: str = "1 hour") -> DataFrame:
    """Tumbling or sliding event-time counts with a watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (sdf.withWatermark(ts, watermark).groupBy(w.alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_events"))


def sessions(sdf: DataFrame, ts: str, key: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Session windows per key (idle gap)."""
    return (sdf.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events"))


def dedupe_within_watermark(sdf: DataFrame, ts: str, key: list[str], delay: str = "5 minutes") -> DataFrame:
    """The same call within the watermark delay is one draft.  Spark keeps a key's state for the delay
    after its first call and until the batch in which the watermark passes that ends, so what counts as
    the same call also depends on the batches."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


STATE_OUT = "claim_id string, opened long, status string, status_rank int, n_accepted long, n_rejected long, last long, closed boolean"
STATE_SCHEMA = "claim_id array<string>, opened array<long>, code array<int>, n_accepted array<long>, n_rejected array<long>, last array<long>"
CLAIM_BUCKETS = 4096  # groups of claims with one state each; part of the checkpoint, so it never changes
_STATUSES = list(STATUS_RANK)
_RANKS = np.array([*STATUS_RANK.values(), -1])  # by code: the place in _STATUSES, the last one any other status


def _fold(state: tuple | None, us: np.ndarray, code: np.ndarray, ttl_us: int) -> list[tuple]:
    """The lives that ``state`` and the transitions (in order) make, the last one still open: (opened, code,
    accepted, rejected, last).  A pause longer than ``ttl_us`` ends a life; a move is accepted when it does
    not go backward, so the rank is the running maximum."""
    before = np.concatenate([[state[4] if state else us[0]], us[:-1]])
    starts = np.flatnonzero(us - before > ttl_us)
    lives, ends = [], [*starts, len(us)]
    if state is None or (len(starts) and starts[0] == 0):
        if state:
            lives.append(state)
        state = None
    first = 0
    for end in ends:
        if end == first:
            continue
        opened, held, accepted, rejected, _ = state or (int(us[first]), len(_STATUSES), 0, 0, 0)
        rank = _RANKS[code[first:end]]
        top = np.maximum.accumulate(np.concatenate([[_RANKS[held]], rank]))
        ok = rank >= top[:-1]
        hits = np.flatnonzero(ok)
        lives.append((opened, int(code[first + hits[-1]]) if len(hits) else int(held), accepted + len(hits),
                      rejected + int((~ok).sum()), int(us[end - 1])))
        state, first = None, end
    return lives


def _claim_rows(rows: list[tuple]) -> pd.DataFrame:
    """A row for each (claim, life, closed)."""
    claims, lives, closed = zip(*rows)
    opened, code, accepted, rejected, last = zip(*lives)
    return pd.DataFrame({"claim_id": pd.Series(claims, dtype=object), "opened": opened, "status": pd.Series([(*_STATUSES, None)[c] for c in code], dtype=object),
                         "status_rank": _RANKS[list(code)].astype("int32"), "n_accepted": accepted, "n_rejected": rejected,
                         "last": last, "closed": closed})


def _advance(ttl_us: int):
    def run(_key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {c: tuple(life) for c, *life in zip(*state.get)} if state.exists else {}
        out, seen = [], set()
        # of the rows in a batch only three narrow arrays and the claims are kept, whatever their number
        parts = [] if state.hasTimedOut else \
            [[p[c].to_numpy() for c in ("claim_id", "us", "event_id", "code")] for p in pdfs if len(p)]
        if parts:
            claims, us, ids, code = (np.concatenate(x) for x in zip(*parts))
            number, names = pd.factorize(claims, use_na_sentinel=False)
            order = np.lexsort((ids, us, number))
            number, us, code = number[order], us[order], code[order]
            cuts = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(us)]):
                claim = names[number[a]]
                claim = claim if isinstance(claim, str) else None
                lives = _fold(held.get(claim), us[a:b], code[a:b], ttl_us)
                held[claim] = lives[-1]
                seen.add(claim)
                out += [(claim, life, True) for life in lives[:-1]] + [(claim, lives[-1], False)]
        now = state.getCurrentWatermarkMs()
        for claim in [c for c, life in held.items() if c not in seen and (life[4] + ttl_us) // 1000 < now]:
            out.append((claim, held.pop(claim), True))
        if held:
            state.update((list(held), *[[int(x) for x in column] for column in zip(*held.values())]))
            state.setTimeoutTimestamp((min(life[4] for life in held.values()) + ttl_us) // 1000)
        elif state.exists:
            state.remove()
        if out:
            yield _claim_rows(out)
    return run


def claim_state_machine(sdf: DataFrame, ttl_days: int = 30, watermark: str = "1 hour") -> DataFrame:
    """Per-claim state from transition events (applyInPandasWithState).

    Claims are dealt by hash into ``CLAIM_BUCKETS`` groups, so that a micro-batch calls Python once for many claims;
    the state of a group carries the accepted status of its open claims across batches.  Input order within a claim is (ts, event_id).  A claim without a
    transition for ``ttl_days`` is closed: its state goes when the watermark passes that
    moment, a later transition opens the claim anew.  A pause is measured between the event
    times themselves, so the rows do not depend on the batches.  Output: a row for each claim
    and opening, again each time it changes.  Transitions older than the watermark are dropped.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _STATUSES)), F.col("status")), F.lit(0)), F.lit(len(_STATUSES) + 1)) - 1
    rows = sdf.withWatermark("ts", watermark).select(F.pmod(F.xxhash64("claim_id"), F.lit(CLAIM_BUCKETS)).cast("int").alias("bucket"),
                                                     "claim_id", "ts", F.unix_micros("ts").alias("us"), "event_id", place.cast("int").alias("code"))
    out = rows.groupBy("bucket").applyInPandasWithState(
        _advance(ttl_days * 86_400_000_000), STATE_OUT, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("claim_id", F.timestamp_micros("opened").alias("opened_ts"), "status", "status_rank", "n_accepted", "n_rejected",
                      F.timestamp_micros("last").alias("last_ts"), "closed")


def stream_static_join(sdf: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Enrich a stream with a static dimension (re-read per batch)."""
    return sdf.join(dim, key, how)


def stream_stream_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, within: str,
                       watermark: str = "1 day") -> DataFrame:
    """Both sides watermarked; right event within ``within`` after the left one."""
    lw = left.withWatermark(lts, watermark).alias("l")
    rw = right.withWatermark(rts, watermark).alias("r")
    cond = F.expr(f"l.{key} = r.{key} AND r.{rts} >= l.{lts} AND r.{rts} <= l.{lts} + interval {within}")
    return lw.join(rw, cond, "inner")


def late_rows_sink(path_on_time: str, path_late: str, ts: str, tolerance: str = "1 hour",
                   state_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Per batch, rows older than (max event time seen before this batch - tolerance)
    go to the late table instead of being silently dropped.  The running max is kept
    in a one-row table next to the outputs so a restarted job continues from it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev_max = None
        if state_path and path_exists(spark, state_path):
            # running max of earlier batches only (a replay ignores its own state row)
            st = spark.read.parquet(state_path).filter(F.col("_batch_id") < batch_id)
            prev_max = st.agg(F.max("max_ts")).scalar()
        if prev_max is not None:
            cut = prev_max - F.expr(f"INTERVAL {tolerance}")
            late = F.coalesce(F.col(ts) < cut, F.lit(False))
            batch.filter(late).write.mode("overwrite").parquet(batch_path(path_late, batch_id))
            batch.filter(~late).write.mode("overwrite").parquet(batch_path(path_on_time, batch_id))
        else:
            batch.write.mode("overwrite").parquet(batch_path(path_on_time, batch_id))
        if state_path:
            batch.agg(F.max(ts).alias("max_ts")).write.mode("overwrite").parquet(batch_path(state_path, batch_id))
    return sink


def scd2_merge_sink(log_path: str, history_path: str, key: str, ts: str, tracked: list[str], deleted: str,
                    carry: list[str], n_buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """SCD-2 maintained from a change stream, out-of-order changes included.

    Each micro-batch appends its change rows to a change log bucketed by key hash, then
    rebuilds the SCD-2 versions of only the buckets it touched from their full change
    log and replaces those history partitions (dynamic partition overwrite).  A late
    change therefore re-opens / re-closes its neighbours' intervals, and a replayed
    batch rewrites the same buckets to the same content (idempotent).  The list of
    touched buckets is bounded by ``n_buckets``.
    """
    from fundlake.operators.history import scd2

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int"))
        b = b.withColumn("_batch_id", F.lit(batch_id).cast("bigint"))
        touched = [r.bucket for r in b.select("bucket").distinct().collect()]  # <= n_buckets values
        if not touched:
            return
        log = b
        if path_exists(spark, log_path):
            # replayed batch: drop its earlier copy from the touched buckets, then append
            old = spark.read.parquet(log_path).filter(F.col("bucket").isin(touched))
            log = old.filter(F.col("_batch_id") != batch_id).unionByName(b)
        tmp = f"{log_path}_stage_{batch_id}"
        log.select(*b.columns).write.mode("overwrite").partitionBy("bucket").parquet(tmp)
        fresh = spark.read.parquet(tmp)

        def replace(df: DataFrame, path: str) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        replace(fresh, log_path)
        replace(scd2(fresh, key, ts, tracked, deleted, carry=carry + ["bucket"]), history_path)
    return sink
