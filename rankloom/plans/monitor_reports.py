"""Monitoring: run histories, canonical chains, directives, samples, retention, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import query_intent, url_path
from ..functions.html import extracted
from ..operators.ranks import running
from ..operators.samples import fair_sample, first_rows
from ..operators.tables import written
from ..sources.views import QUERY_PAGE, SNAPSHOTS, query_page, snapshots, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_RUNS = f"""{SNAPSHOTS}, runs AS (SELECT CAST(CAST(inspected_at AS DATE) AS VARCHAR) AS run, count(*) AS n_attempts, count(*) FILTER (WHERE verdict IS NULL) AS n_failed, count(*) FILTER (WHERE verdict = 'FAIL') AS n_issues FROM snapshots GROUP BY 1)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per daily run with its attempts, failures and issues."""
    verdict = F.col("verdict")
    return snapshots(spark, sf_dir).groupBy(F.to_date("inspected_at").cast("string").alias("run")).agg(F.count("*").alias("n_attempts"), F.count_if(verdict.isNull()).alias("n_failed"), F.count_if(verdict == "FAIL").alias("n_issues"))


@report("crawl_history", f"WITH {_RUNS} SELECT * FROM runs ORDER BY run DESC LIMIT 5")
def crawl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).orderBy(F.desc("run")).limit(5)


@report("run_changes", f"WITH {_RUNS} SELECT run, n_issues, n_issues - lag(n_issues) OVER (ORDER BY run) AS delta FROM runs QUALIFY lag(n_issues) OVER (ORDER BY run) IS NOT NULL")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the one before; runs are few."""
    before = F.lag("n_issues").over(W.partitionBy(F.lit(1)).orderBy("run"))
    return runs(spark, sf_dir).withColumn("before", before).filter("before IS NOT NULL").select("run", "n_issues", (F.col("n_issues") - F.col("before")).alias("delta"))


@report(
    "technical_baseline",
    f"WITH {_RUNS} SELECT max(run) AS run, arg_max(n_issues, run) AS n_issues FROM runs WHERE run < '2024-01-25' AND n_failed * 2 < n_attempts",
)
def technical_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run before a date that is complete enough to compare with."""
    return runs(spark, sf_dir).filter("run < '2024-01-25' AND n_failed * 2 < n_attempts").agg(F.max("run").alias("run"), F.max_by("n_issues", "run").alias("n_issues"))


@report(
    "monitoring_status",
    f"WITH {SNAPSHOTS} SELECT url, CASE max(CASE WHEN verdict = 'FAIL' THEN 3 WHEN verdict IS NULL THEN 2 WHEN verdict = 'NEUTRAL' THEN 1 ELSE 0 END) WHEN 3 THEN 'failing' WHEN 2 THEN 'unknown' WHEN 1 THEN 'neutral' ELSE 'passing' END AS status, date_diff('day', max(CAST(inspected_at AS DATE)), DATE '2024-02-01') AS stale_days FROM snapshots GROUP BY url",
)
def monitoring_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of each URL, and the days since it was last looked at."""
    rank = F.when(F.col("verdict") == "FAIL", 3).when(F.col("verdict").isNull(), 2).when(F.col("verdict") == "NEUTRAL", 1).otherwise(0)
    t = snapshots(spark, sf_dir).groupBy("url").agg(F.max(rank).alias("worst"), F.max(F.to_date("inspected_at")).alias("last"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("passing", "neutral", "unknown", "failing")]), F.col("worst") + 1)
    return t.select("url", status.alias("status"), F.datediff(F.lit("2024-02-01").cast("date"), "last").cast("long").alias("stale_days"))


@report(
    "canonical_chain",
    "WITH c AS (SELECT page_id AS page, CASE WHEN page_id % 4 = 3 THEN page_id - 1 WHEN page_id % 4 = 2 THEN page_id - 2 ELSE page_id END AS canonical FROM pages) SELECT a.page, a.canonical, b.canonical AS final FROM c a JOIN c b ON b.page = a.canonical WHERE b.canonical <> b.page AND a.canonical <> a.page",
)
def canonical_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose canonical page names another one."""
    k = F.col("page_id") % 4
    c = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.when(k == 3, F.col("page_id") - 1).when(k == 2, F.col("page_id") - 2).otherwise(F.col("page_id")).alias("canonical")).filter("page <> canonical")
    return c.alias("a").join(c.select(F.col("page").alias("canonical"), F.col("canonical").alias("final")), "canonical").select("page", "canonical", "final")


@report(
    "robots_directives",
    """WITH d AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'noindex, nofollow' WHEN 1 THEN 'googlebot: noindex' WHEN 2 THEN 'bingbot: noindex, googlebot: nofollow' WHEN 3 THEN 'none' ELSE '' END AS raw FROM pages),
    p AS (SELECT page_id, list_filter([trim(x) FOR x IN string_split(raw, ',')], lambda x: x <> '') AS parts FROM d)
    SELECT page_id, len(list_filter(parts, lambda x: x IN ('noindex', 'none', 'googlebot: noindex', 'googlebot: none'))) > 0 AS noindex, len(list_filter(parts, lambda x: x IN ('nofollow', 'none', 'googlebot: nofollow', 'googlebot: none'))) > 0 AS nofollow FROM p""",
)
def robots_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives that hold for one crawler: its own and those for all."""
    raw = F.element_at(F.array(*[F.lit(x) for x in ("noindex, nofollow", "googlebot: noindex", "bingbot: noindex, googlebot: nofollow", "none", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    parts = F.transform(F.split(raw, ","), lambda x: F.trim(x))
    has = lambda d: F.exists(parts, lambda x: x.isin(d, "none", f"googlebot: {d}", "googlebot: none"))
    return table(spark, sf_dir, "pages").select("page_id", has("noindex").alias("noindex"), has("nofollow").alias("nofollow"))


@report("property_suggestions", "SELECT concat('/', split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 2), '/') AS folder, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1 HAVING count(DISTINCT url) >= 20")
def property_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First folders with enough URLs for a property of their own."""
    folder = F.concat(F.lit("/"), F.split_part(url_path(F.col("url")), F.lit("/"), F.lit(2)), F.lit("/"))
    return table(spark, sf_dir, "pages").groupBy(folder.alias("folder")).agg(F.countDistinct("url").alias("n_urls")).filter("n_urls >= 20")


@report(
    "history_retention",
    "WITH e AS (SELECT user_id, event_id, octet_length(encode(props)) + 1000 AS bytes FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM e) SELECT user_id, event_id FROM r WHERE n <= 20 AND used <= 15200",
)
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a key, up to a number of rows and of bytes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.octet_length("props") + 1000).alias("bytes"))
    first = first_rows(e, ["user_id"], [F.desc("event_id")], 20, "n")  # the rest of a key can't stay, whatever its bytes
    used = F.sum("bytes").over(W.partitionBy("user_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used", used).filter("used <= 15200").select("user_id", "event_id")


#: Rows that a key and all keys may keep, and bytes of all.
KEY_ROWS, ALL_ROWS, ALL_BYTES = 15, 4000, 3_500_000


@report(
    "global_retention",
    f"""WITH e AS (SELECT user_id, event_id, ts, octet_length(encode(props)) + 1000 AS bytes FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS key_rank, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS total_rank, sum(bytes) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM e)
    SELECT user_id, event_id, key_rank, total_rank, used FROM r WHERE key_rank <= {KEY_ROWS} AND total_rank <= {ALL_ROWS} AND used <= {ALL_BYTES}""",
)
def global_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of each key that are also among the newest of all, within a budget of bytes."""
    newest = [F.desc("ts"), F.desc("event_id")]
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.octet_length("props") + 1000).cast("long").alias("bytes"))
    kept = running(e, [], newest, place="total_rank", sums={"used": F.col("bytes")}).filter((F.col("total_rank") <= ALL_ROWS) & (F.col("used") <= ALL_BYTES))
    # a key's newest rows of all are its newest among these
    return first_rows(kept, ["user_id"], newest, KEY_ROWS, "key_rank").select("user_id", "event_id", "key_rank", "total_rank", "used")


#: Addresses that a run checks.
MOST_CHECKED = 200
_FNV = "list_reduce(list_concat([2166136261], list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296)"


@report(
    "fair_sample",
    f"""WITH RECURSIVE l AS (SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, '<a href="([^"#?]+)', 1)) AS link FROM pages), h AS (SELECT source, link, {_FNV.format('link')} AS k FROM l),
    s AS (SELECT source, list(link ORDER BY k, link) AS urls, {_FNV.format('source')} AS k FROM h GROUP BY source), o AS (SELECT urls, row_number() OVER (ORDER BY k, source) - 1 AS i, count(*) OVER () AS n FROM s),
    step AS (SELECT 0::BIGINT AS i, 0::BIGINT AS idle, []::VARCHAR[] AS taken UNION ALL
      SELECT i + 1, CASE WHEN new IS NULL THEN idle + 1 ELSE 0 END, CASE WHEN new IS NULL THEN taken ELSE list_append(taken, new) END
      FROM (SELECT step.*, o.n, list_filter(o.urls, lambda u: NOT list_contains(step.taken, u))[1] AS new FROM step JOIN o ON o.i = step.i % o.n WHERE len(step.taken) < {MOST_CHECKED} AND step.idle < o.n)),
    last AS (SELECT taken FROM step ORDER BY i DESC LIMIT 1)
    SELECT pick, taken[pick] AS url FROM (SELECT taken, unnest(range(1, len(taken) + 1))::INT AS pick FROM last)""",
)
def fair_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that a run would check: pages by turns, each giving its next, up to MOST_CHECKED."""
    read = extracted(table(spark, sf_dir, "pages"), "url").select(F.col("url").alias("source"), F.explode("links.href").alias("href"))
    return fair_sample(read.select("source", F.regexp_extract("href", "^([^?#]+)", 1).alias("url")).filter("url <> ''"), MOST_CHECKED)


@report(
    "skip_reasons",
    "WITH s AS (SELECT CASE WHEN url LIKE '%#%' THEN 'fragment' WHEN url LIKE '%?utm%' THEN 'tracking' WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%.html' THEN 'extension' END AS reason FROM pages) SELECT coalesce(reason, 'unclassified') AS reason, count(*) AS n, CASE WHEN reason IN ('fragment', 'tracking') THEN 'harmless' WHEN reason IS NULL THEN 'unknown' ELSE 'review' END AS impact FROM s GROUP BY reason",
)
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    reason = F.when(u.contains("#"), "fragment").when(u.contains("?utm"), "tracking").when(u.contains("?"), "query").when(u.endswith(".html"), "extension").otherwise("unclassified")
    n = table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("impact", F.when(F.col("reason").isin("fragment", "tracking"), "harmless").when(F.col("reason") == "unclassified", "unknown").otherwise("review"))


@report(
    "query_intents",
    f"""WITH {QUERY_PAGE}, q AS (SELECT DISTINCT concat(query, CASE length(query) % 4 WHEN 0 THEN ' price' WHEN 1 THEN ' reviews' WHEN 2 THEN ' guide' ELSE '' END) AS query FROM query_page),
    t AS (SELECT query, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS w FROM q)
    SELECT CASE WHEN list_has_any(w, ['buy', 'price', 'pricing', 'cheap', 'discount', 'order', 'coupon']) THEN 'transactional' WHEN list_has_any(w, ['best', 'top', 'review', 'reviews', 'vs', 'compare', 'alternative', 'alternatives']) THEN 'commercial'
      WHEN list_has_any(w, ['how', 'what', 'why', 'when', 'guide', 'tutorial', 'examples']) THEN 'informational' ELSE 'mixed' END AS intent, count(*) AS n FROM t GROUP BY 1""",
)
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("query") % 4
    after = F.when(k == 0, " price").when(k == 1, " reviews").when(k == 2, " guide").otherwise("")
    q = query_page(spark, sf_dir).select(F.concat("query", after).alias("query")).distinct()
    return q.groupBy(query_intent(F.col("query")).alias("intent")).agg(F.count("*").alias("n"))


@report(
    "template_leaders",
    f"""WITH {QUERY_PAGE}, t AS (SELECT concat('/', split_part(page, '/', 4), '/') AS template, query, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1, 2)
    SELECT template, query, impressions FROM t QUALIFY row_number() OVER (PARTITION BY template ORDER BY impressions DESC, query) <= 3""",
)
def template_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most shown queries of each template, seeds for research."""
    from ..functions.columns import page_template

    t = query_page(spark, sf_dir).groupBy(page_template(F.col("page")).alias("template"), "query").agg(F.sum("impressions").alias("impressions"))
    n = F.row_number().over(W.partitionBy("template").orderBy(F.desc("impressions"), "query"))
    return t.withColumn("n", n).filter("n <= 3").select("template", "query", "impressions")


#: Seeds that a run of research takes.
MOST_SEEDS = 60


@report(
    "research_seeds",
    f"""WITH {QUERY_PAGE}, t AS (SELECT concat('/', split_part(page, '/', 4), '/') AS label, query, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1, 2), best AS (SELECT 'template' AS source, label, query, impressions FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY impressions DESC, query) = 1),
    q AS (SELECT split_part(query, ' ', 2) AS label, query, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1, 2), lead AS (SELECT 'query-cluster' AS source, label, query, impressions FROM q QUALIFY row_number() OVER (PARTITION BY label ORDER BY impressions DESC, query) = 1),
    c AS (SELECT * FROM best UNION ALL SELECT * FROM lead), k AS (SELECT *, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS key FROM c WHERE impressions > 0),
    f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY source = 'template' DESC, impressions DESC, query, label) = 1)
    SELECT query, source, label, impressions FROM f ORDER BY source = 'template' DESC, impressions DESC, query, label LIMIT {MOST_SEEDS}""",
)
def research_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that research starts from: the most shown one of each template, then of each group of queries about the same thing, each once."""
    from ..functions.columns import page_template
    from ..functions.text import pattern_text

    q = query_page(spark, sf_dir).select("query", "impressions", page_template(F.col("page")).alias("template"), F.element_at(F.split("query", " "), 2).alias("thing"))
    q = written(q.groupBy("query", "template", "thing").agg(F.sum("impressions").alias("impressions")), "seeds")

    def best(label: str, source: str) -> DataFrame:
        shown = q.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), "query").agg(F.sum("impressions").alias("impressions"))
        return first_rows(shown, ["label"], [F.desc("impressions"), F.col("query")], 1, "n").select(F.lit(source).alias("source"), "label", "query", "impressions")

    seeds = best("template", "template").union(best("thing", "query-cluster")).filter("impressions > 0").withColumn("key", pattern_text(F.col("query"))).filter("key <> ''")
    order = [F.desc(F.col("source") == "template"), F.desc("impressions"), F.col("query"), F.col("label")]
    return first_rows(seeds, ["key"], order, 1, "n").orderBy(*order).limit(MOST_SEEDS).select("query", "source", "label", "impressions")
