"""Reports over what providers plug in, from files that are exported from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from ..sources import providers
from ..sources.exports import read_export
from ..sources.views import search_export, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_LINES_SQL = "e AS (SELECT CAST(ts AS DATE) AS date, concat('/p/', event_id % 97) AS page, event_id % 5 AS visits, event_id % 100 <> 33 AS valid FROM events)"


def exported_visits(spark: SparkSession, sf_dir: str) -> str:
    """The events as a provider's export, JSON lines in a folder for each day; every hundredth line is broken."""
    path = f"{shared_dir(spark)}/visits-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.concat(F.lit("/p/"), (F.col("event_id") % 97).cast("string")).alias("page"), (F.col("event_id") % 5).alias("visits")))
    broken = F.when(F.col("event_id") % 200 == 33, F.substring(line, 1, 9)).when(F.col("event_id") % 200 == 133, '{"page":"/p","visits":-1}').otherwise(line)
    rows = e.select(F.to_date("ts").alias("date"), broken.alias("value"))
    rows.repartition("date").write.partitionBy("date").option("compression", "none").text(f"{path}/text")
    return f"{path}/text"


def read_visits(spark: SparkSession, path: str, **days: str) -> DataFrame:
    providers.register(spark)
    return spark.read.format("landing_page_visits").options(**days).load(path)


@report("provider_visits", f"WITH {_LINES_SQL} SELECT date, CASE WHEN valid THEN page END AS page, sum(CASE WHEN valid THEN visits END)::BIGINT AS visits, count(*) AS n FROM e WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2")
def provider_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of landing pages by day, from a provider's files of the days that are asked for."""
    visits = read_visits(spark, exported_visits(spark, sf_dir), startDate="2024-01-05", endDate="2024-01-20")
    return visits.groupBy("date", "page").agg(F.sum("visits").alias("visits"), F.count("*").alias("n"))


#: Rows that a provider's report retains.
ROW_LIMIT = 500


@report(
    "provider_summary",
    f"""WITH {_LINES_SQL}, v AS (SELECT date, page, sum(visits)::BIGINT AS visits FROM e WHERE valid GROUP BY 1, 2), k AS (SELECT * FROM v ORDER BY visits DESC, date, page LIMIT {ROW_LIMIT})
    SELECT (SELECT count(*) FROM e) AS returned, (SELECT count(*) FROM e WHERE NOT valid) AS invalid, (SELECT count(*) FROM v) AS available, count(*) AS retained, coalesce(sum(visits), 0)::BIGINT AS visits, (SELECT count(*) FROM v) > {ROW_LIMIT} AS limit_reached,
      CASE WHEN (SELECT count(*) FROM v) > {ROW_LIMIT} OR EXISTS (SELECT 1 FROM e WHERE NOT valid) THEN 'partial' ELSE 'complete' END AS status FROM k""",
)
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider's files hold, and what of it the report retains."""
    return providers.visits_summary(read_visits(spark, exported_visits(spark, sf_dir)), ROW_LIMIT)


@report(
    "provider_values",
    """WITH k AS (SELECT o_orderkey AS id, o_orderkey % 7 AS c, o_orderkey AS n FROM orders),
    v(c, path, kind, value) AS (VALUES (0, '$', 'object', NULL), (0, '$.key', 'number', 'n'), (0, '$.list', 'array', NULL), (0, '$.list[0]', 'boolean', 'true'), (0, '$.list[1]', 'null', NULL), (0, '$.list[2]', 'object', NULL), (0, '$.list[2].x', 'string', 'é'),
      (1, NULL, 'refused', 'json'), (2, NULL, 'refused', 'object'), (3, NULL, 'refused', 'depth'), (4, NULL, 'refused', 'bytes'), (5, NULL, 'refused', 'null'), (6, '$', 'object', NULL))
    SELECT id, path, kind, CASE WHEN value = 'n' THEN CAST(n AS VARCHAR) ELSE value END AS value FROM k JOIN v USING (c)""",
)
def provider_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the objects that providers send, by a table function that refuses what goes beyond its bounds."""
    providers.register(spark)
    k = F.col("o_orderkey") % 7
    deep = F.concat(F.repeat(F.lit('{"a":'), 17), F.lit("1"), F.repeat(F.lit("}"), 17))
    sent = (
        F.when(k == 0, F.concat(F.lit('{"key": '), F.col("o_orderkey").cast("string"), F.lit(', "list": [true, null, {"x": "é"}]}'))).when(k == 1, '{"key": ').when(k == 2, "[1]").when(k == 3, deep)
        .when(k == 4, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 65_536), F.lit('"}'))).when(k == 6, "{}")
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), sent.alias("sent"))
    return spark.sql("SELECT id, path, kind, value FROM {rows}, LATERAL json_values(sent)", rows=rows)


# --- exports of other tools ------------------------------------------------------------------------------------------------------------------

#: The forms that an export is written in: delimiter, encoding, and names of its columns.
_FORMS = [(",", "UTF-8", ["Top queries", "Clicks", "Impressions", "CTR", "Position"]), (";", "UTF-16", ["Position", "Top queries", "Impressions", "Clicks", "CTR"]), ("\t", "UTF-8", ["Clicks", "Top queries", "CTR", "Position", "Impressions"])]


@report(
    "export_rows",
    """WITH r AS (SELECT p_name AS query, p_partkey * 1001 AS impressions, p_partkey % 50 AS clicks, p_partkey % 9 + 1.5 AS position, p_partkey FROM part),
    k AS (SELECT query, max(p_partkey) AS p_partkey FROM r GROUP BY 1) SELECT r.query, clicks::DOUBLE AS clicks, impressions::DOUBLE AS impressions, (p_partkey % 90 + 0.5) / 100 AS ctr, position::DOUBLE AS position FROM r JOIN k USING (query, p_partkey)""",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of search exports in several forms, one folder of files with their own delimiters, encodings and orders of columns."""
    k, path = F.col("p_partkey"), f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    cells = {
        "Top queries": F.col("p_name"), "Clicks": (k % 50).cast("string"), "Impressions": F.format_number(k * 1001, 0), "CTR": F.concat(F.format_number(k % 90 + 0.5, 1), F.lit("%")), "Position": (k % 9 + 1.5).cast("string"),
    }
    parts = table(spark, sf_dir, "part")
    for i, (delimiter, encoding, names) in enumerate(_FORMS):
        mine = parts.filter(k % len(_FORMS) == i).select(*[cells[n].alias(n) for n in names])
        mine.coalesce(1).write.mode("append").csv(path, header=True, sep=delimiter, encoding=encoding, quote='"', escape='"')
    return search_export(read_export(spark, path))
