"""Registered streaming queries.

Each builder stages the driver ``events`` table as time-ordered file chunks (a
derived copy in the shared checkpoint folder), runs a Structured Streaming job
over it with ``availableNow`` and a fresh checkpoint, and returns the sink read
back as a batch DataFrame.  With in-order files no row is late, so the streamed
result must equal the batch SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake.sources.domain import dealer_key, N_ACTIVITIES
from fundlake.sources.driver import read_table
from fundlake.session import checkpoint_root, path_exists
from fundlake.operators import quality
from fundlake.streaming import streams

REGISTRY: dict = {}

# Fixed values of the staged event feed and the stream rules.
CHUNK_DAYS = 5
MIN_ATTENDEES = 10
STATUS_OF_EVENT = {"view": "Submitted", "click": "Under_Review", "signup": "Approved", "purchase": "Paid",
                   "error": "Rejected"}

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

_STAGED: dict[tuple, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def staged_events(spark: SparkSession, sf_dir: str, reverse: bool = False) -> str:
    """Events as file chunks of CHUNK_DAYS days, written in time order (or reversed)."""
    key = (sf_dir, reverse, spark.sparkContext.applicationId)
    if key in _STAGED:
        return _STAGED[key]
    ev = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()  # two dates
    n = (hi - lo).days // CHUNK_DAYS + 1
    ev = ev.withColumn("_chunk", F.floor(F.datediff(F.to_date("ts"), F.lit(lo)) / CHUNK_DAYS).cast("int"))
    dest = checkpoint_root(spark, "staged-events")
    order = list(range(n))
    streams.stage_files(ev, dest, "_chunk", order[::-1] if reverse else order, ["ts", "event_id"])
    _STAGED[key] = dest + "/*"
    return _STAGED[key]


def _events_stream(spark, sf_dir, reverse=False) -> DataFrame:
    return streams.file_stream(spark, staged_events(spark, sf_dir, reverse), EVENT_SCHEMA)


def _transitions(sdf: DataFrame) -> DataFrame:
    st = None
    for k, v in STATUS_OF_EVENT.items():
        st = F.when(F.col("event_type") == k, F.lit(v)) if st is None else st.when(F.col("event_type") == k, F.lit(v))
    return sdf.select(
        F.concat(F.lit("TC-"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string"))
        .alias("claim_id"), dealer_key(F.col("user_id")).alias("dealer_id"), "ts", "event_id", st.alias("status"))


_EV_SQL = "ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM events)"
_TR_SQL = _EV_SQL + """,
tr AS (SELECT concat('TC-', cast(user_id AS string), '-', cast(event_id % 7 AS string)) AS claim_id,
              concat('D-', printf('%06d', user_id)) AS dealer_id, ts, event_id,
              CASE event_type WHEN 'view' THEN 'Submitted' WHEN 'click' THEN 'Under_Review' WHEN 'signup' THEN 'Approved'
                              WHEN 'purchase' THEN 'Paid' WHEN 'error' THEN 'Rejected' END AS status
       FROM ev)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# --------------------------------------------------------------------------- L1
@register("stream_bronze_events", _with(_EV_SQL, "SELECT * FROM ev"))
def stream_bronze_events(spark, sf_dir):
    """L1 + A13: file stream -> bronze with provenance; provenance columns not compared."""
    dest = checkpoint_root(spark, "bronze-events")
    streams.ingest_bronze(spark, staged_events(spark, sf_dir), EVENT_SCHEMA, dest, "events")
    return spark.read.parquet(dest).select("event_id", "ts", "user_id", "event_type", "value", "props")


# ---------------------------------------------------------------- L2 / L3 / L11
def _marketing(sdf: DataFrame, dealers: DataFrame) -> DataFrame:
    x = sdf.select(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("event_id"),
        dealer_key(F.col("user_id")).alias("dealer_id"),
        F.concat(F.lit("ACT-"), F.lpad((F.col("event_id") % N_ACTIVITIES).cast("string"), 2, "0"))
        .alias("activity_type_id"),
        F.to_date("ts").alias("start_date"),
        F.col("value").cast("int").alias("attendees"))
    return streams.stream_static_join(x, dealers, "dealer_id", "left")


_MK_SQL = _EV_SQL + f""",
mk AS (SELECT concat('EV-', cast(e.event_id AS string)) AS event_id, concat('D-', printf('%06d', e.user_id)) AS dealer_id,
              concat('ACT-', lpad(cast(e.event_id % 22 AS string), 2, '0')) AS activity_type_id,
              CAST(e.ts AS DATE) AS start_date, CAST(trunc(e.value) AS INTEGER) AS attendees
       FROM ev e),
mk2 AS (SELECT mk.*, d.region_id, d.tier FROM mk LEFT JOIN (
          SELECT concat('D-', printf('%06d', c_custkey)) AS dealer_id,
                 concat('RGN-', r_name, '-', cast(n_nationkey AS string)) AS region_id,
                 CASE WHEN c_custkey % 20 = 0 THEN 'Platinum' WHEN c_custkey % 20 < 5 THEN 'Gold'
                      WHEN c_custkey % 20 < 13 THEN 'Silver' ELSE 'Authorized' END AS tier
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) d
        ON mk.dealer_id = d.dealer_id)"""


def _run_marketing(spark, sf_dir) -> tuple[str, str]:
    from fundlake.plans.model import Model
    dealers = Model(spark, sf_dir).dim_dealer.select("dealer_id", "region_id", "tier")
    silver = checkpoint_root(spark, "silver-marketing")
    quarantine = checkpoint_root(spark, "quarantine-marketing")
    rules = {"attendees_minimum": f"attendees >= {MIN_ATTENDEES}", "dealer_known": "region_id IS NOT NULL"}
    src = staged_events(spark, sf_dir)
    streams.bronze_to_silver(spark, src, EVENT_SCHEMA, lambda s: _marketing(s, dealers), rules, silver,
                             quarantine, "marketing")
    return silver, quarantine


@register("stream_silver_marketing_events", _with(_MK_SQL, f"""
SELECT event_id, dealer_id, activity_type_id, start_date, attendees, region_id, tier FROM mk2
WHERE coalesce(attendees >= {MIN_ATTENDEES}, false) AND region_id IS NOT NULL"""))
def stream_silver_marketing_events(spark, sf_dir):
    """L2 + L11: stateless conform, stream-static dealer enrichment, drop rules."""
    silver, _ = _run_marketing(spark, sf_dir)
    return spark.read.parquet(silver).drop("_batch_id")


@register("stream_quarantine_events", _with(_MK_SQL, f"""
SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(attendees >= {MIN_ATTENDEES}, false) THEN 'attendees_minimum' END,
                                CASE WHEN region_id IS NULL THEN 'dealer_known' END) AS reason
FROM mk2 WHERE NOT (coalesce(attendees >= {MIN_ATTENDEES}, false) AND region_id IS NOT NULL)"""))
def stream_quarantine_events(spark, sf_dir):
    """L3: quarantine side output of the same micro-batches."""
    _, quarantine = _run_marketing(spark, sf_dir)
    return spark.read.parquet(quarantine).select("event_id", "reason")


# --------------------------------------------------------------------------- L7
@register("stream_hourly_status_counts", _with(_TR_SQL, """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, status,
       count(*) AS n_events
FROM tr GROUP BY 1, 2, 3"""))
def stream_hourly_status_counts(spark, sf_dir):
    """Tumbling one-hour counts per status with a watermark (update mode log)."""
    sdf = streams.windowed_counts(_transitions(_events_stream(spark, sf_dir)), "ts", ["status"], "1 hour")
    log = checkpoint_root(spark, "hourly-log")
    streams.run_available_now(sdf, streams.append_batches(log), checkpoint_root(spark, "ckpt-hourly"), "update")
    return streams.latest_updates(spark, log, ["window_start", "window_end", "status"],
                                  ["window_start", "window_end", "status", "n_events"])


# --------------------------------------------------------------------------- L8
@register("stream_sliding_density_7d", _with(_TR_SQL, """
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, dealer_id, count(*) AS n_events
FROM (SELECT dealer_id, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS window_start
      FROM tr, range(0, 7) r(i)) x
GROUP BY 1, 2, 3"""))
def stream_sliding_density_7d(spark, sf_dir):
    """Sliding 7-day windows, 1-day step, transitions per dealer."""
    sdf = streams.windowed_counts(_transitions(_events_stream(spark, sf_dir)), "ts", ["dealer_id"], "7 days",
                                  "1 day", watermark="1 day")
    log = checkpoint_root(spark, "sliding-log")
    streams.run_available_now(sdf, streams.append_batches(log), checkpoint_root(spark, "ckpt-sliding"), "update")
    return streams.latest_updates(spark, log, ["window_start", "window_end", "dealer_id"],
                                  ["window_start", "window_end", "dealer_id", "n_events"])


DENSITY_LIMIT = 20


@register("stream_density_alerts", _with(_TR_SQL, f"""
SELECT dealer_id, count(*) AS n_windows, max(n_events) AS max_events, min(window_start) AS first_window FROM (
  SELECT window_start, dealer_id, count(*) AS n_events
  FROM (SELECT dealer_id, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS window_start FROM tr, range(0, 7) r(i)) x GROUP BY 1, 2) y
WHERE n_events > {DENSITY_LIMIT} GROUP BY 1"""))
def stream_density_alerts(spark, sf_dir):
    """Dealers with more than 20 transitions in a sliding window of seven days, from the stream's counts."""
    r = stream_sliding_density_7d(spark, sf_dir).where(F.col("n_events") > DENSITY_LIMIT)
    return r.groupBy("dealer_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("n_events").alias("max_events"), F.min("window_start").alias("first_window"))


# --------------------------------------------------------------------------- L9
@register("stream_sessions", _with(_EV_SQL, """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
FROM (SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
      FROM (SELECT user_id, ts, event_id,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                          OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS new_s FROM ev) a) b
GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR"""))
def stream_sessions(spark, sf_dir):
    """Closed session windows (30-minute idle gap) per user."""
    sdf = streams.sessions(_events_stream(spark, sf_dir), "ts", "user_id", "30 minutes")
    out = checkpoint_root(spark, "sessions")
    # session windows support append mode only: a session is emitted once the
    # watermark (max event time - 1 hour) has passed its end
    streams.run_available_now(sdf, streams.append_batches(out), checkpoint_root(spark, "ckpt-sessions"), "append")
    return spark.read.parquet(out).drop("_batch_id")


# --------------------------------------------------------------------------- L6
CLAIM_TTL_DAYS = 5  # a claim without a transition for so long is closed


@register("stream_claim_state", _with(_TR_SQL, f"""
SELECT claim_id, min(ts) AS opened_ts, arg_max(status, ord) FILTER (WHERE accepted) AS status,
       CAST(max(status_rank) AS INTEGER) AS status_rank,
       count_if(accepted) AS n_accepted, count_if(NOT accepted) AS n_rejected, max(ts) AS last_ts,
       max(ts) + INTERVAL {CLAIM_TTL_DAYS} DAY < (SELECT max(ts) FROM tr) - INTERVAL 1 HOUR
         OR life < max(max(life)) OVER (PARTITION BY claim_id) AS closed
FROM (SELECT claim_id, life, status, status_rank, ts, row_number() OVER (PARTITION BY claim_id, life ORDER BY ts, event_id) AS ord,
             coalesce(status_rank >= max(status_rank) OVER (PARTITION BY claim_id, life ORDER BY ts, event_id
                                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
      FROM (SELECT *, sum(opens) OVER (PARTITION BY claim_id ORDER BY ts, event_id) AS life FROM (
              SELECT *, CASE status WHEN 'Draft' THEN 0 WHEN 'Submitted' THEN 1 WHEN 'Under_Review' THEN 2
                                    WHEN 'Approved' THEN 3 WHEN 'Rejected' THEN 3 WHEN 'Paid' THEN 4 END AS status_rank,
                     CASE WHEN ts - lag(ts) OVER (PARTITION BY claim_id ORDER BY ts, event_id) > INTERVAL {CLAIM_TTL_DAYS} DAY
                          THEN 1 ELSE 0 END AS opens
              FROM tr) t) y) x
GROUP BY claim_id, life"""))
def stream_claim_state(spark, sf_dir):
    """Claim state machine with backward moves rejected (applyInPandasWithState); a claim closes after
    ``CLAIM_TTL_DAYS`` without a transition, its state goes with the watermark."""
    sdf = streams.claim_state_machine(_transitions(_events_stream(spark, sf_dir)), CLAIM_TTL_DAYS)
    log = checkpoint_root(spark, "claim-state-log")
    streams.run_available_now(sdf, streams.append_batches(log), checkpoint_root(spark, "ckpt-claim-state"), "update")
    return streams.latest_updates(spark, log, ["claim_id", "opened_ts"],
                                  ["claim_id", "opened_ts", "status", "status_rank", "n_accepted", "n_rejected", "last_ts", "closed"])


# -------------------------------------------------------------------------- L12
@register("stream_submission_decision_join", _with(_TR_SQL, """
SELECT l.claim_id, l.event_id AS submitted_event_id, l.ts AS submitted_ts, r.event_id AS decided_event_id,
       r.ts AS decided_ts
FROM tr l JOIN tr r ON l.claim_id = r.claim_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 7 DAY
WHERE l.status = 'Submitted' AND r.status = 'Approved'"""))
def stream_submission_decision_join(spark, sf_dir):
    """Stream-stream join, decision within 7 days after submission, both sides watermarked."""
    tr = _transitions(_events_stream(spark, sf_dir))
    left = tr.filter(F.col("status") == "Submitted").select("claim_id", F.col("event_id").alias("submitted_event_id"),
                                                           F.col("ts").alias("submitted_ts"))
    right = tr.filter(F.col("status") == "Approved").select("claim_id", F.col("event_id").alias("decided_event_id"),
                                                           F.col("ts").alias("decided_ts"))
    j = streams.stream_stream_join(left, right, "claim_id", "submitted_ts", "decided_ts", "7 days", "8 days")
    j = j.select(F.col("l.claim_id").alias("claim_id"), "submitted_event_id", "submitted_ts", "decided_event_id",
                 "decided_ts")
    out = checkpoint_root(spark, "join-out")
    streams.run_available_now(j, streams.append_batches(out), checkpoint_root(spark, "ckpt-join"), "append")
    return spark.read.parquet(out).drop("_batch_id")


# --------------------------------------------------------------------------- L5
# The replay of the staged files, one batch a file: a batch gives the first call of every key without
# state; a key's state ends with the first batch whose watermark (latest call of the batches before, less
# five minutes) has reached its first call plus five minutes.
@register("stream_dedupe_calls", _with("RECURSIVE " + _EV_SQL + f""",
calls AS (
  SELECT event_id, ts, sha256(concat(cast(user_id AS string), '|', event_type)) AS call_hash,
         CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM ev) AS BIGINT) // {CHUNK_DAYS} AS batch FROM ev),
first_calls AS (
  SELECT call_hash, batch, ts, event_id FROM calls QUALIFY row_number() OVER (PARTITION BY call_hash, batch ORDER BY ts, event_id) = 1),
marks AS (
  SELECT b.batch, (SELECT max(ts) FROM calls c WHERE c.batch < b.batch) - INTERVAL 5 MINUTE AS mark
  FROM (SELECT unnest(range(0, (SELECT max(batch) + 1 FROM calls))) AS batch) b),
replay AS (
  SELECT k.call_hash, CAST(-1 AS BIGINT) AS batch, CAST(NULL AS TIMESTAMP) AS ends, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts
  FROM (SELECT DISTINCT call_hash FROM calls) k
  UNION ALL
  SELECT r.call_hash, m.batch,
    CASE WHEN coalesce(r.ends, f.ts + INTERVAL 5 MINUTE) > coalesce(m.mark, TIMESTAMP '1970-01-01') THEN coalesce(r.ends, f.ts + INTERVAL 5 MINUTE) END,
    CASE WHEN r.ends IS NULL THEN f.event_id END, CASE WHEN r.ends IS NULL THEN f.ts END
  FROM replay r JOIN marks m ON m.batch = r.batch + 1
  LEFT JOIN first_calls f ON f.call_hash = r.call_hash AND f.batch = m.batch)""",
                                       "SELECT event_id, ts, call_hash FROM replay WHERE event_id IS NOT NULL"))
def stream_dedupe_calls(spark, sf_dir):
    """L5 (stream form): the same call hash within the 5-minute watermark is one draft; state ends with the
    watermark.  The files are replayed in time order, one a batch."""
    sdf = _events_stream(spark, sf_dir).withColumn(
        "call_hash", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    d = streams.dedupe_within_watermark(sdf, "ts", ["call_hash"], "5 minutes")
    out = checkpoint_root(spark, "dedupe-out")
    streams.run_available_now(d.select("event_id", "ts", "call_hash"), streams.append_batches(out),
                              checkpoint_root(spark, "ckpt-dedupe"), "append")
    return spark.read.parquet(out).drop("_batch_id")


# -------------------------------------------------------------------------- L10
@register("stream_late_rows", _with(_EV_SQL, f"""
SELECT count_if(ts < (SELECT max(ts) FROM ev WHERE floor((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM ev)) / {CHUNK_DAYS})
                                               = (SELECT max(floor((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM ev)) / {CHUNK_DAYS})) FROM ev))
                     - INTERVAL 1 HOUR
               AND floor((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM ev)) / {CHUNK_DAYS})
                   < (SELECT max(floor((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM ev)) / {CHUNK_DAYS})) FROM ev)) AS n_late,
       count(*) AS n_rows
FROM ev"""))
def stream_late_rows(spark, sf_dir):
    """Chunks replayed newest first; rows behind the running max (minus 1 hour) are
    routed to a late table and counted, not dropped."""
    src = staged_events(spark, sf_dir, reverse=True)
    sdf = streams.file_stream(spark, src, EVENT_SCHEMA)
    on_time, late, state = (checkpoint_root(spark, n) for n in ("late-on-time", "late-late", "late-state"))
    streams.run_available_now(sdf, streams.late_rows_sink(on_time, late, "ts", "1 hour", state),
                              checkpoint_root(spark, "ckpt-late"))
    n_on = spark.read.parquet(on_time).agg(F.count(F.lit(1))).scalar()
    late_df = spark.read.parquet(late if path_exists(spark, late) else on_time)
    if not path_exists(spark, late):  # no late rows written
        late_df = late_df.limit(0)
    return late_df.agg(F.count(F.lit(1)).alias("n_late")).select("n_late", (F.col("n_late") + n_on).alias("n_rows"))


# ------------------------------------------------------------------ L5 batch twin
@register("idempotency_window_batch", _with(_EV_SQL, """
SELECT call_hash, count(*) AS n_requests, count_if(is_new) AS n_drafts FROM (
  SELECT sha256(concat(cast(user_id AS string), '|', event_type)) AS call_hash, ts,
         lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL
         OR ts > lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 5 MINUTE AS is_new
  FROM ev) x GROUP BY call_hash"""))
def idempotency_window_batch(spark, sf_dir):
    """L5 (batch form): a request starts a new draft when the previous request with the
    same call hash is more than 5 minutes older (lag gap)."""
    from pyspark.sql import Window
    ev = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.withColumn("call_hash", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    w = Window.partitionBy("call_hash").orderBy("ts", "event_id")
    prev = F.lag("ts").over(w)
    x = ev.withColumn("is_new", prev.isNull() | (F.col("ts") > prev + F.expr("INTERVAL 5 MINUTES")))
    return x.groupBy("call_hash").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("is_new").alias("n_drafts"))


# -------------------------------------------------------------------------- L15
@register("stream_audit_rows", f"""WITH {_EV_SQL}
SELECT concat('D-', printf('%06d', user_id)) AS actor, event_type AS action, ts AS logged_at,
       concat('{{"event_id":', CAST(event_id AS VARCHAR), CASE WHEN props IS NULL THEN '' ELSE concat(',"n_props":', CAST(length(props) AS VARCHAR)) END, '}}') AS payload
FROM ev WHERE event_type IN ('purchase', 'signup', 'error')""")
def stream_audit_rows(spark, sf_dir):
    """Audit rows of purchases, signups and errors appended by a stream, a folder for each batch."""
    ev = _events_stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error")).select(
        dealer_key(F.col("user_id")).alias("actor"), F.col("event_type").alias("action"), "ts", "event_id",
        F.length("props").alias("n_props"))
    path = checkpoint_root(spark, "audit-stream")
    streams.append_audit(streams.audit_rows(ev, "actor", "action", ["event_id", "n_props"]), path,
                         checkpoint_root(spark, "ckpt-audit"))
    return spark.read.parquet(path).select("actor", "action", "logged_at", "payload")


# -------------------------------------------------------------------------- L13
CHANGE_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()), T.StructField("dealer_id", T.StringType()),
    T.StructField("dealer_name", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("region_id", T.StringType()), T.StructField("sales_rep_id", T.StringType()),
    T.StructField("tier", T.StringType()), T.StructField("is_deleted", T.BooleanType()),
    T.StructField("ts", T.TimestampType())])
def replay_order(years: list[int]) -> list[int]:
    """All modification years, out of event-time order on purpose: even ones first, latest first."""
    return sorted(years, key=lambda y: (y % 2, -y))



def _scd2_sql():
    from fundlake.plans.catalog_ops import CHANGES_SQL
    from fundlake.plans.oracle import q
    return q("""
SELECT account_id, dealer_id, dealer_name, tier, region_id, country, sales_rep_id, effective_from, effective_to, is_current
FROM dealer_history""", CHANGES_SQL)


@register("stream_scd2_dealer_history", _scd2_sql())
def stream_scd2_dealer_history(spark, sf_dir):
    """SCD-2 dealer history maintained by foreachBatch from an out-of-order change stream."""
    from fundlake.plans.catalog_ops import _changes
    from fundlake.plans.model import Model
    ch = _changes(Model(spark, sf_dir)).withColumn("_chunk", F.year("ts"))
    src = checkpoint_root(spark, "staged-changes")
    years = [r[0] for r in ch.select("_chunk").distinct().collect()]  # one value a calendar year
    streams.stage_files(ch, src, "_chunk", replay_order(years))
    sdf = streams.file_stream(spark, src + "/*", CHANGE_SCHEMA)
    log, hist = checkpoint_root(spark, "scd2-log"), checkpoint_root(spark, "scd2-history")
    sink = streams.scd2_merge_sink(log, hist, "account_id", "ts",
                                   ["dealer_name", "tier", "region_id", "country", "sales_rep_id"], "is_deleted",
                                   ["dealer_id"])
    streams.run_available_now(sdf, sink, checkpoint_root(spark, "ckpt-scd2"))
    h = spark.read.parquet(hist)
    return h.select("account_id", "dealer_id", "dealer_name", "tier", "region_id", "country", "sales_rep_id",
                    "effective_from", "effective_to", "is_current")


# ----------------------------------------------------------------------- B4: facts as streams
FILES_PER_BATCH = 4


def silver_stream(spark, bronze: DataFrame, conform, rules: dict[str, str], name: str) -> DataFrame:
    """One bronze feed through a stream to its silver table and its quarantine; both read back, with ``reason``
    (empty: silver).  The feed is staged in one write and read ``FILES_PER_BATCH`` files a batch."""
    src = streams.stage_once(bronze, checkpoint_root(spark, f"bronze-{name}"))
    silver, quarantine = checkpoint_root(spark, f"silver-{name}"), checkpoint_root(spark, f"quarantine-{name}")
    streams.bronze_to_silver(spark, src, bronze.schema, conform, rules, silver, quarantine, name, FILES_PER_BATCH)
    good = spark.read.parquet(silver).drop("_batch_id").withColumn("reason", F.lit(""))
    return good.unionByName(spark.read.parquet(quarantine).drop("_batch_id"))


def _dirt_sql():
    from fundlake.plans.catalog_ops import DIRTY_SQL
    from fundlake.plans.oracle import q
    claims = q("""
SELECT claim_id, 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fiscal_year, CAST(requested_amount_usd AS DECIMAL(12,2)) AS requested_amount_usd,
       concat_ws(',', CASE WHEN NOT r1 THEN 'claim_amount_positive' END, CASE WHEN NOT r2 THEN 'status_valid' END,
                 CASE WHEN NOT r3 THEN 'paid_le_approved' END, CASE WHEN NOT r4 THEN 'dealer_not_null' END) AS reason FROM dirty_tagged""", DIRTY_SQL)
    allocations = q("""
SELECT allocation_id, 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fiscal_year,
       CASE WHEN (n + fy) % 97 = 0 THEN CAST(0 AS DECIMAL(14,2)) ELSE allocated_usd END AS allocated_usd,
       concat_ws(',', CASE WHEN (n + fy) % 97 = 0 THEN 'alloc_amount_positive' END, CASE WHEN (n + fy) % 89 = 0 THEN 'alloc_dates_ordered' END) AS reason
FROM (SELECT *, CAST(substr(dealer_id, 3) AS BIGINT) AS n FROM coop_allocation) x""")
    orders = q("""
SELECT concat_ws('-', order_id, line_no, line_key) AS order_line_id,
       'FY' || lpad(CAST((year(order_date) - CASE WHEN month(order_date) < 3 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
       CASE WHEN CAST(substr(order_id, 3) AS BIGINT) % 101 = 0 THEN -net_revenue_usd ELSE net_revenue_usd END AS net_revenue_usd,
       CASE WHEN CAST(substr(order_id, 3) AS BIGINT) % 101 = 0 AND net_revenue_usd > 0 THEN 'order_amount_nonneg' ELSE '' END AS reason
FROM sell_through_order""")
    return claims, allocations, orders


_CLAIMS_SQL, _ALLOCATIONS_SQL, _ORDERS_SQL = _dirt_sql()


@register("stream_silver_claims", _CLAIMS_SQL)
def stream_silver_claims(spark, sf_dir):
    """The raw claim feed (with planted defects) as a stream to silver and quarantine."""
    from fundlake.plans.silver import conform_claims
    from fundlake.sources.domain import Domain
    r = silver_stream(spark, Domain(spark, sf_dir).dirty_claims, conform_claims, quality.CLAIM_STREAM_RULES, "claims")
    return r.select("claim_id", "fiscal_year", "requested_amount_usd", "reason")


@register("stream_silver_allocations", _ALLOCATIONS_SQL)
def stream_silver_allocations(spark, sf_dir):
    """Allocations as a stream; the feed is a stand-in with amounts of 0 and dates out of order by dealer and year."""
    from fundlake.plans.silver import conform_allocations
    from fundlake.sources.domain import Domain
    k = F.substring("dealer_id", 3, 32).cast("bigint") + F.col("fy")
    a = Domain(spark, sf_dir).coop_allocation \
        .withColumn("allocated_usd", F.when(k % 97 == 0, F.lit(0).cast("decimal(14,2)")).otherwise(F.col("allocated_usd"))) \
        .withColumn("expiration_date", F.when(k % 89 == 0, F.date_sub("allocation_date", 1)).otherwise(F.col("expiration_date")))
    r = silver_stream(spark, a, conform_allocations, quality.ALLOCATION_RULES, "allocations")
    return r.select("allocation_id", "fiscal_year", "allocated_usd", "reason")


@register("stream_silver_orders", _ORDERS_SQL)
def stream_silver_orders(spark, sf_dir):
    """Order lines as a stream; the feed is a stand-in in which every 101st order is a credit below zero."""
    from fundlake.plans.silver import conform_orders
    from fundlake.sources.domain import Domain
    credit = F.substring("order_id", 3, 32).cast("bigint") % 101 == 0
    o = Domain(spark, sf_dir).sell_through_order.withColumn(
        "net_revenue_usd", F.when(credit, -F.col("net_revenue_usd")).otherwise(F.col("net_revenue_usd")).cast("decimal(14,2)"))
    r = silver_stream(spark, o, conform_orders, quality.ORDER_RULES, "orders")
    return r.select("order_line_id", "fiscal_year", "net_revenue_usd", "reason")
