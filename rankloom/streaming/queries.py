"""Streams over bounded inputs, run to their end, so that they can be compared with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from ..sources.views import ACCESS_LOG, access_log, table
from . import logs, ordered, progress

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result of a stream after all that is there: written by batch, the last one in complete mode, all of them in append mode."""
    spark, root = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = f"{root}/out"
    write = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The access log as text files of the shared folder."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    access_log(spark, sf_dir).repartition(8).write.text(path)
    return path


@report("stream_line_totals", f"WITH {ACCESS_LOG} SELECT 'valid' AS kind, count(*) AS n FROM access_log UNION ALL SELECT 'invalid', (SELECT count(*) FROM events) - count(*) FROM access_log")
def stream_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(logs.line_totals(logs.log_lines(spark, log_files(spark, sf_dir))), "line-totals")


@report("stream_crawler_totals", f"WITH {ACCESS_LOG} SELECT family, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM access_log WHERE family IS NOT NULL GROUP BY 1")
def stream_crawler_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(logs.crawler_totals(logs.log_stream(spark, log_files(spark, sf_dir))), "crawler-totals")


@report("stream_status_windows", f"WITH {ACCESS_LOG} SELECT date_trunc('hour', ts) AS start, status, count(*) AS requests FROM access_log GROUP BY 1, 2")
def stream_status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by hour and status. Files come in any order, so nothing is late within the days that the log covers."""
    windows = run_available(logs.windowed_statuses(logs.log_stream(spark, log_files(spark, sf_dir)), late="400 days"), "status-windows")
    return windows.select(F.col("window.start").alias("start"), "status", "requests")


@report(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n_events FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events less than six hours apart."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = run_available(logs.sessions(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), gap="6 hours", late="400 days"), "sessions")
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n_events")


@report("stream_first_seen", f"WITH {ACCESS_LOG} SELECT DISTINCT family, path FROM access_log WHERE family IS NOT NULL")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crawler and path once, when it is first met."""
    return run_available(logs.first_seen(logs.log_stream(spark, log_files(spark, sf_dir)), "400 days"), "first-seen", "append").select("family", "path")


# --- late and disordered data: a replay in parts ------------------------------------------------------------------------------------------

#: Parts of the replay and files of a part; days of a part; an event of LATE_ONES comes two parts after its own.
PARTS, FILES, PART_DAYS, LATE_ONES, DELAY = 6, 12, 6, 17, "1 day"
_PART = f"least(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / {PART_DAYS}) AS INT) + CASE WHEN event_id % 50 = {LATE_ONES} THEN 2 ELSE 0 END, {PARTS - 1})"
#: Events with the time that the watermark had passed when their part came.
_REPLAY = f"""parts AS (SELECT *, {_PART} AS part FROM events), tops AS (SELECT part, max(ts) AS top FROM parts GROUP BY 1),
  replay AS (SELECT p.*, date_trunc('millisecond', (SELECT max(top) FROM tops t WHERE t.part < p.part)) - INTERVAL 1 DAY AS passed, date_trunc('millisecond', (SELECT max(top) FROM tops t WHERE t.part < p.part - 1)) - INTERVAL 1 DAY AS passed_before FROM parts p)"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of parts, one a batch; the last part, one event of long after, closes all that is open."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    day = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / PART_DAYS).cast("int")
    cut = events.withColumn("part", F.least(day + F.when(F.col("event_id") % 50 == LATE_ONES, 2).otherwise(0), F.lit(PARTS - 1)))
    root = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    end = spark.createDataFrame([(-1, -1, "2099-01-01 00:00:00", "view")], "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    # files are read in the order in which they were written, FILES a batch, so each part has as many; all tasks read and write a part
    for n in range(PARTS):
        cut.filter(F.col("part") == n).drop("part").repartition(FILES).write.mode("append").parquet(root)
        made = len(spark.read.schema(end.schema).parquet(root).inputFiles())
        for _ in range(made, FILES * (n + 1)):  # tasks without rows write no file, but one of an empty table
            end.limit(0).coalesce(1).write.mode("append").parquet(root)
    end.coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(root)


@report(
    "stream_late_windows",
    f"""WITH {_REPLAY} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM replay WHERE passed_before IS NULL OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > passed_before GROUP BY 1, 2""",
)
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by window and kind, put out once the watermark has closed a window; events of closed windows are dropped."""
    windows = replayed(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    out = run_available(windows, "late-windows", "append")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n").filter("start < '2090-01-01'")


_KINDS = {"view": "queue", "click": "reserve", "signup": "post", "purchase": "complete", "error": "fail"}
_RESERVED_HOURS = 12
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"


@report(
    "stream_tasks",
    f"""WITH RECURSIVE {_REPLAY}, e AS (SELECT user_id % 40 * 5 + event_id % 5 AS task, epoch_ms(ts) AS ms, {_KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id % 40 * 5 + event_id % 5 ORDER BY epoch_ms(ts), event_id) AS n
      FROM replay WHERE passed IS NULL OR epoch_ms(ts) > epoch_ms(passed)),
    run AS (SELECT DISTINCT task, 0::BIGINT AS n, 'new' AS state, -1::BIGINT AS until, 0 AS moved, 0 AS expired, 0 AS ignored FROM e
      UNION ALL SELECT task, n, coalesce(new, now), CASE WHEN new = 'posting' THEN ms + {_RESERVED_HOURS * 3600000} WHEN new IS NULL THEN until ELSE -1 END, moved + (new IS NOT NULL)::INT, expired + lapsed::INT, ignored + (new IS NULL)::INT
      FROM (SELECT *, CASE WHEN kind = 'queue' AND now IN ('new', 'complete', 'failed') THEN 'pending' WHEN kind = 'reserve' AND now = 'pending' THEN 'posting' WHEN kind = 'post' AND now = 'posting' THEN 'posted' WHEN kind = 'complete' AND now = 'posted' THEN 'complete'
          WHEN kind = 'fail' AND now IN ('posting', 'posted') THEN 'failed' END AS new
        FROM (SELECT e.task, e.n, e.ms, e.kind, r.until, r.moved, r.expired, r.ignored, r.state = 'posting' AND r.until < e.ms AS lapsed, CASE WHEN r.state = 'posting' AND r.until < e.ms THEN 'pending' ELSE r.state END AS now
          FROM run r JOIN e ON e.task = r.task AND e.n = r.n + 1))),
    last AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC) AS back FROM run)
    SELECT task, CASE WHEN state = 'posting' THEN 'pending' ELSE state END AS state, moved::BIGINT AS n_moved, expired + (state = 'posting')::INT::BIGINT AS n_expired, ignored::BIGINT AS n_ignored FROM last WHERE back = 1""",
)
def stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from pending to complete or failed, from disordered and late events; reservations expire by timers."""
    e = replayed(spark, sf_dir)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type"))
    task = F.when(F.col("user_id") >= 0, F.col("user_id") % 40 * 5 + F.col("event_id") % 5).otherwise(-1)
    log = run_available(ordered.task_log(e.select(task.alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind")), _RESERVED_HOURS * 3_600_000, DELAY), "tasks", "append")
    t = log.filter("key >= 0").groupBy(F.col("key").alias("task"))
    return t.agg(
        F.max_by("state", F.struct("at", F.col("cause") == "expired", "seq")).alias("state"), F.count_if(~F.col("cause").isin("expired", "ignored")).alias("n_moved"), F.count_if(F.col("cause") == "expired").alias("n_expired"), F.count_if(F.col("cause") == "ignored").alias("n_ignored")
    )


_PER_WINDOW, _PER_DAY = 2, 12


@report(
    "stream_quota",
    f"""WITH {_REPLAY}, e AS (SELECT event_id AS seq, user_id % 20 AS key, epoch_ms(ts) AS ms FROM replay WHERE passed IS NULL OR epoch_ms(ts) > epoch_ms(passed)),
    w AS (SELECT *, row_number() OVER (PARTITION BY key, ms // 3600000 ORDER BY ms, seq) AS in_window FROM e),
    d AS (SELECT *, count(*) FILTER (WHERE in_window <= {_PER_WINDOW}) OVER (PARTITION BY key, ms // 86400000 ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
    SELECT key, seq, CASE WHEN before >= {_PER_DAY} THEN 'day-limit' WHEN in_window > {_PER_WINDOW} THEN 'window-limit' ELSE 'reserved' END AS decision FROM d""",
)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a limit for each hour and each day, decided in the order of their time."""
    e = replayed(spark, sf_dir).select(F.when(F.col("user_id") >= 0, F.col("user_id") % 20).otherwise(-1).alias("key"), "ts", F.col("event_id").alias("seq"))
    return run_available(ordered.quota_log(e, 3_600_000, _PER_WINDOW, _PER_DAY, DELAY), "quota", "append").filter("key >= 0").select("key", "seq", "decision")


@report("stream_progress", f"WITH {_REPLAY} SELECT part::BIGINT AS batch, count(*) AS n_rows FROM parts GROUP BY 1 UNION ALL SELECT {PARTS}, 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each batch, as a listener of the running stream was told."""
    root = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    return progress.progress_of(replayed(spark, sf_dir).select("event_id"), f"{root}/out", f"{root}/checkpoint")
