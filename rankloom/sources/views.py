"""Canonical views of search, crawl and log data over the test tables, and readers of export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, page, date, impressions, clicks, position: one row per line item."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier = F.col("l_suppkey") % 10
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("query"),
        F.concat(F.lit("https://shop.example/"), F.lower("p_type"), F.lit("/supplier-"), supplier.cast("string")).alias("page"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("long").alias("impressions"),
        F.floor(F.col("l_quantity") * F.col("l_discount") + 0.5).cast("long").alias("clicks"),
        (1 + (F.length("p_name") * 5 + supplier * 3 + F.col("l_linenumber")) % 20).cast("long").alias("position"),
    )


#: The same in SQL.
SEARCH_ROWS = """
search_rows AS (
  SELECT p_name AS query, concat('https://shop.example/', lower(p_type), '/supplier-', CAST(l_suppkey % 10 AS VARCHAR)) AS page,
    CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS impressions, CAST(floor(l_quantity * l_discount + 0.5) AS BIGINT) AS clicks,
    1 + (length(p_name) * 5 + (l_suppkey % 10) * 3 + l_linenumber) % 20 AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

QUERY_PAGE = (
    SEARCH_ROWS
    + """,
query_page AS (
  SELECT query, page, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, sum(position * impressions)::DOUBLE / sum(impressions)::DOUBLE AS position,
    sum(clicks)::DOUBLE / sum(impressions)::DOUBLE AS ctr, count(*) AS n_rows
  FROM search_rows GROUP BY query, page)"""
)


def aggregate_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums, click-through rate and impression-weighted position per key; null rates where there are no impressions."""
    seen = F.sum("impressions").cast("double")
    share = lambda x: F.when(seen > 0, F.sum(x).cast("double") / seen)
    return rows.groupBy(*keys).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), share(F.col("position") * F.col("impressions")).alias("position"), share(F.col("clicks")).alias("ctr"), F.count("*").alias("n_rows")
    )


def query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_rows(search_rows(spark, sf_dir), "query", "page")


def query_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_page as a written table, for reports that read it more than once."""
    return written(query_page(spark, sf_dir), "query-page")


def search_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, clicks, impressions from the events of each day."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type")
    clicked, viewed = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type").isin("click", "view"))
    return events.groupBy("date").agg(clicked.alias("clicks"), viewed.alias("impressions"))


SEARCH_DAILY = """
search_daily AS (
  SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS impressions
  FROM events GROUP BY 1)"""

AGENTS = ["Googlebot/2.1", "bingbot/2.0", "GPTBot/1.1", "ClaudeBot/1.0", "Mozilla/5.0", "PerplexityBot/1.0", "CCBot/2.0"]


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the combined format, one per event; every 500th is cut short."""
    e = table(spark, sf_dir, "events")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("user_id") % len(AGENTS) + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_id") % 23 == 0, "404").when(F.col("event_id") % 31 == 0, "301").otherwise("200")
    line = F.concat(
        F.lit("127.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /docs/'), (F.col("event_id") % 97).cast("string"), F.lit("?ref="), F.col("event_type"),
        F.lit(' HTTP/1.1" '), status, F.lit(" "), (F.col("event_id") % 1000).cast("string"), F.lit(' "-" "'), agent, F.lit('"'),
    )
    return e.select(F.when(F.col("event_id") % 500 == 499, F.substring(line, 1, 40)).otherwise(line).alias("value"))


#: The parsed log in SQL, straight from the events.
ACCESS_LOG = """
access_log AS (
  SELECT date_trunc('second', ts) AS ts, concat('/docs/', CAST(event_id % 97 AS VARCHAR)) AS path, event_id % 1000 AS bytes,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 23 = 0 THEN 404 WHEN event_id % 31 = 0 THEN 301 ELSE 200 END AS status,
    CASE user_id % 7 WHEN 0 THEN 'Googlebot' WHEN 1 THEN 'Bingbot' WHEN 2 THEN 'OpenAI' WHEN 3 THEN 'Anthropic' WHEN 5 THEN 'Perplexity' WHEN 6 THEN 'CCBot' END AS family
  FROM events WHERE event_id % 500 <> 499)"""

#: The combined format from its fields: host, identity, user, [time], "request", status, size, and perhaps "referrer" and "agent".
_WORD, _QUOTED = r"\S+", r'"[^"]*"'
_REQUEST = r'"(\w+) (\S+)[^"]*"'
COMBINED = rf"^{_WORD} {_WORD} {_WORD} \[([^\]]+)\] {_REQUEST} ([0-9]{{3}}) ([0-9]+|-)(?: {_QUOTED} \"([^\"]*)\")?\s*$"


def parse_log(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """ts, method, path, status, bytes, agent, family, category and valid for every line, after the columns to keep; lines that don't
    parse have nulls.

    The pattern runs once a line: its groups are put side by side and split.
    """
    from ..functions.columns import crawler_category, crawler_family, url_path

    groups = F.split(F.regexp_replace(column, COMBINED, "\x01$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01")
    # as a generated row, so that no filter or column further up repeats the pattern
    split = lines.select(F.explode(F.array(F.when(F.size(groups) == 7, groups))).alias("g"), F.octet_length(column).alias("line_bytes"), *(keep or []))
    part = lambda i: F.nullif(F.get("g", F.lit(i)), F.lit(""))
    parsed = split.select(
        *(keep or []), F.try_to_timestamp(part(1), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), part(2).alias("method"), url_path(part(3)).alias("path"),
        part(4).try_cast("int").alias("status"), part(5).try_cast("bigint").alias("bytes"), part(6).alias("agent"), "line_bytes",
    )
    named = parsed.withColumn("family", crawler_family(F.col("agent")))
    valid = F.col("ts").isNotNull() & F.col("method").isNotNull() & F.col("path").isNotNull() & F.col("status").between(100, 599)
    return named.withColumn("category", crawler_category(F.col("family"))).withColumn("valid", F.coalesce(valid, F.lit(False)))


LOG_FIELDS = {"timestamp": ["@timestamp", "timestamp", "time"], "method": ["requestMethod", "method"], "path": ["requestUri", "path", "url"], "status": ["status", "statusCode"], "agent": ["userAgent", "user_agent"]}


def parse_json_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same fields from one JSON object per line, under any of the names that log shippers give them."""
    keys = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    pick = lambda name: F.coalesce(*[F.col("_m")[k] for k in LOG_FIELDS[name]])
    named = lines.select(keys.alias("_m"))
    return named.select(F.to_timestamp(pick("timestamp")).alias("ts"), pick("method").alias("method"), pick("path").alias("path"), pick("status").cast("int").alias("status"), pick("agent").alias("agent"))


def read_csv_export(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A CSV with a header and quoted cells; all columns are strings. With multi_line cells hold line breaks, and a file is one task's."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=multi_line, quote='"', escape='"', inferSchema=False)


EXPORT_NAMES = {"Top pages": "page", "Top queries": "query", "Clicks": "clicks", "Impressions": "impressions", "CTR": "ctr", "Position": "position"}


def search_export(raw: DataFrame) -> DataFrame:
    """A search export with its numbers parsed ("4,321", "2.78%"); of rows that repeat a key the one with the most impressions stays."""
    from pyspark.sql import Window as W

    named = raw.select(*[F.col(f"`{c}`").alias(EXPORT_NAMES[c]) for c in raw.columns if c in EXPORT_NAMES])
    key = "page" if "page" in named.columns else "query"
    number = lambda c: F.expr(f"try_cast(regexp_replace({c}, '[,%]', '') AS DOUBLE)")
    rows = named.select(key, number("clicks").alias("clicks"), number("impressions").alias("impressions"), (number("ctr") / 100).alias("ctr"), number("position").alias("position"))
    order = W.partitionBy(key).orderBy(F.desc("impressions"), F.desc("clicks"), "position")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def backlinks(raw: DataFrame) -> DataFrame:
    """source, target, anchor, nofollow of a link export: valid http(s) URLs, each link once."""
    rows = raw.select(F.col("`Source URL`").alias("source"), F.col("`Target URL`").alias("target"), F.coalesce("`Anchor Text`", F.lit("")).alias("anchor"), (F.lower(F.coalesce("`Nofollow`", F.lit(""))).isin("true", "yes", "1", "nofollow")).alias("nofollow"))
    ok = F.col("source").rlike("^https?://[^/\\s]+") & F.col("target").rlike("^https?://[^/\\s]+")
    return rows.filter(ok).groupBy("source", "target", "anchor").agg(F.max("nofollow").alias("nofollow"))


def ranked_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, domain, rank, volume, traffic: the best position of each supplier for each name."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("keyword"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"), F.lit(".example")).alias("domain"),
        (1 + (F.length("p_name") * 5 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 100).alias("rank"), F.col("l_quantity").cast("long").alias("volume"),
    )
    return rows.groupBy("keyword", "domain").agg(F.min("rank").alias("rank"), F.sum("volume").alias("volume"))


RANKED = """
ranked AS (
  SELECT p_name AS keyword, concat('supplier-', CAST(l_suppkey AS VARCHAR), '.example') AS domain, min(1 + (length(p_name) * 5 + l_suppkey * 3 + l_linenumber) % 100) AS rank, sum(l_quantity::BIGINT)::BIGINT AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections of a URL over time: url, inspection_id, inspected_at, verdict (null for a failed attempt)."""
    verdict = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "purchase", "FAIL").when(F.col("event_type") == "signup", "NEUTRAL").otherwise("PASS")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("https://shop.example/u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("inspection_id"), F.col("ts").alias("inspected_at"), verdict.alias("verdict"))


SNAPSHOTS = """
snapshots AS (
  SELECT concat('https://shop.example/u/', CAST(user_id AS VARCHAR)) AS url, event_id AS inspection_id, ts AS inspected_at,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'FAIL' WHEN 'signup' THEN 'NEUTRAL' ELSE 'PASS' END AS verdict FROM events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the links of the pages, as paths; each page is a source of its own."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="([^"#?]+)'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("src"), F.explode(hrefs).alias("dst")).distinct()


LINKS = r"""
links AS (SELECT DISTINCT concat('/p/', CAST(page_id AS VARCHAR)) AS src, unnest(regexp_extract_all(html, '<a href="([^"#?]+)', 1)) AS dst FROM pages)"""
