"""Access logs and events as streams: summaries of keys, windows with late data, latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import parse_log

#: Longer lines are not parsed, but counted.
MOST_LINE_BYTES = 64_000


def log_lines(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """All lines of log files as they arrive, parsed; kind says which are valid, invalid or oversize. Oversize ones are not parsed."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    over = F.octet_length("value") > MOST_LINE_BYTES
    # an over-long line goes on as a blank one of its kind
    parsed = parse_log(lines.select(F.when(over, F.lit("oversize")).otherwise(F.col("value")).alias("value"), over.alias("over")), keep=["over"])
    return parsed.withColumn("kind", F.when(F.col("over"), "oversize").when(F.col("valid"), "valid").otherwise("invalid")).drop("over")


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """The valid records of log files as they arrive."""
    return log_lines(spark, path, files_per_trigger).filter("kind = 'valid'").drop("kind")


def line_totals(lines: DataFrame) -> DataFrame:
    """How many lines of each kind there were; the state is three rows."""
    return lines.groupBy("kind").agg(F.count("*").alias("n"))


def crawler_totals(records: DataFrame) -> DataFrame:
    """Requests, errors and the time span of each crawler; its state is a row for each crawler family."""
    known = records.filter("family IS NOT NULL")
    return known.groupBy("family").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def windowed_statuses(records: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests by status and window; records later than `late` behind the newest are dropped, and so is the state of closed windows."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("requests"))


def crawler_path_windows(records: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests by crawler, path and day. Pairs without an end are kept no longer than the watermark."""
    known = records.filter("family IS NOT NULL").withWatermark("ts", late)
    return known.groupBy(F.window("ts", width), "family", "path").agg(F.count("*").alias("requests"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users (user_id, ts): events less than `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))


def first_seen(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (family, path) when it is first met."""
    return records.filter("family IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["family", "path"])
