"""Access logs, inspection histories and rank runs: parsing, latest states, retention, transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import crawler_category, crawler_family, status_class
from ..operators.rule_joins import domains_above, most_specific_property
from ..operators.samples import first_rows
from ..operators.tables import shared_dir
from ..sources.stores import RUN, SnapshotStore
from ..sources.views import ACCESS_LOG, RANKED, SEARCH_ROWS, SNAPSHOTS, access_log, parse_log, ranked_keywords, search_rows, snapshots, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records of the access log."""
    return parse_log(access_log(spark, sf_dir)).filter("valid")


@report("log_parse", f"WITH {ACCESS_LOG} SELECT ts, path, status, bytes, family FROM access_log")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ts", "path", "status", "bytes", "family")


@report(
    "log_summary",
    f"""WITH {ACCESS_LOG} SELECT (SELECT count(*) FROM events) AS n_lines, count(*) AS n_valid, count(family) AS n_crawler, (SELECT count(*) FROM events) - count(*) AS n_invalid, min(ts) AS first_ts, max(ts) AS last_ts, sum(bytes)::BIGINT AS bytes FROM access_log""",
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all lines, in one pass."""
    ok = F.col("valid")
    kept = lambda c: F.when(ok, F.col(c))
    return parse_log(access_log(spark, sf_dir)).agg(
        F.count("*").alias("n_lines"), F.count_if(ok).alias("n_valid"), F.count(kept("family")).alias("n_crawler"), F.count_if(~ok).alias("n_invalid"),
        F.min(kept("ts")).alias("first_ts"), F.max(kept("ts")).alias("last_ts"), F.sum(kept("bytes")).alias("bytes"),
    )


@report("status_histogram", f"WITH {ACCESS_LOG} SELECT status, count(*) AS requests FROM access_log GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("status").agg(F.count("*").alias("requests")).orderBy("status")


@report(
    "log_crawlers",
    f"""WITH {ACCESS_LOG} SELECT family, CASE WHEN family IN ('Googlebot', 'Bingbot') THEN 'search' ELSE 'ai' END AS category, count(*) AS requests, count(DISTINCT path) AS n_paths, count(*) FILTER (WHERE status >= 400) AS errors, min(ts) AS first_ts, max(ts) AS last_ts
    FROM access_log WHERE family IS NOT NULL GROUP BY 1, 2""",
)
def log_crawlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("family IS NOT NULL").groupBy("family").agg(
        F.count("*").alias("requests"), F.countDistinct("path").alias("n_paths"), F.count_if(F.col("status") >= 400).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return rows.withColumn("category", crawler_category(F.col("family"))).orderBy(F.desc("requests"), "family")


@report(
    "crawler_paths",
    f"""WITH {ACCESS_LOG} SELECT family, path, count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirect,
    count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_error, count(*) FILTER (WHERE status >= 500) AS server_error FROM access_log WHERE family IS NOT NULL GROUP BY 1, 2""",
)
def crawler_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawler and path, with its statuses by class; all pairs are counted, none is capped."""
    kinds = ["success", "redirect", "client_error", "server_error"]
    seen = records(spark, sf_dir).groupBy("agent", "path", "status").agg(F.count("*").alias("n"))
    # agents and statuses are named once for each group of equal ones
    named = seen.select("path", "n", crawler_family(F.col("agent")).alias("family"), status_class(F.col("status")).alias("kind")).filter("family IS NOT NULL")
    return named.groupBy("family", "path").agg(F.sum("n").alias("requests"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])


@report(
    "error_paths",
    f"""WITH {ACCESS_LOG} SELECT family, path, count(*) FILTER (WHERE status >= 400) AS errors, count(*) AS requests FROM access_log WHERE family IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status >= 400) > 0
    ORDER BY errors DESC, requests DESC, family, path LIMIT 100""",
)
def error_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("family IS NOT NULL").groupBy("family", "path").agg(F.count_if(F.col("status") >= 400).alias("errors"), F.count("*").alias("requests"))
    return rows.filter("errors > 0").orderBy(F.desc("errors"), F.desc("requests"), "family", "path").limit(100)


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order of the columns."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


@report("latest_per_key", f"WITH {SNAPSHOTS} SELECT url, inspection_id, verdict FROM snapshots QUALIFY row_number() OVER (PARTITION BY url ORDER BY inspected_at DESC, inspection_id DESC) = 1")
def latest_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(snapshots(spark, sf_dir), ["url"], "inspected_at", "inspection_id").select("url", "inspection_id", "verdict")


@report(
    "win_retention",
    f"""WITH {SNAPSHOTS}, r AS (SELECT url, inspection_id, row_number() OVER (PARTITION BY url ORDER BY inspected_at DESC, inspection_id DESC) AS n, row_number() OVER (PARTITION BY url, verdict IS NULL ORDER BY inspected_at DESC, inspection_id DESC) AS m, verdict FROM snapshots)
    SELECT url, inspection_id FROM r WHERE n <= 5 OR (m = 1 AND verdict IS NOT NULL)""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest inspections of a URL, and the newest that succeeded."""
    rows, newest = snapshots(spark, sf_dir), [F.desc("inspected_at"), F.desc("inspection_id")]
    kept = first_rows(rows, ["url"], newest, 5, "n").union(first_rows(rows.filter("verdict IS NOT NULL"), ["url"], newest, 1, "n"))
    return kept.select("url", "inspection_id").distinct()


@report(
    "snapshot_store",
    f"""WITH {SNAPSHOTS}, d AS (SELECT s.*, CASE WHEN inspected_at < TIMESTAMP '2024-01-11' THEN 1 WHEN inspected_at < TIMESTAMP '2024-01-21' THEN 2 ELSE 4 END AS run FROM snapshots s),
    kept AS (SELECT * FROM d WHERE run > 3 OR NOT ends_with(url, '7')),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY inspected_at DESC, inspection_id DESC) AS n, row_number() OVER (PARTITION BY url, verdict IS NULL ORDER BY inspected_at DESC, inspection_id DESC) AS m FROM kept)
    SELECT url, inspection_id, verdict, concat('run-', run) AS run FROM r WHERE n <= 2 OR (m = 1 AND verdict IS NOT NULL)""",
)
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections written as runs, one of them twice, some URLs deleted between runs, then compacted, then read."""
    rows = snapshots(spark, sf_dir)
    store = SnapshotStore(spark, f"{shared_dir(spark)}/inspections-{uuid.uuid4().hex}", rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), ["url"])
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    first, second, last = rows.filter(F.col("inspected_at") < day(11)), rows.filter((F.col("inspected_at") >= day(11)) & (F.col("inspected_at") < day(21))), rows.filter(F.col("inspected_at") >= day(21))
    store.append("run-1", first)
    store.append("run-2", last)  # a run that went wrong
    store.append("run-2", second)
    store.delete("run-3", rows.filter(F.col("url").endswith("7")).select("url"))
    store.append("run-4", last)
    store.retain([F.desc("inspected_at"), F.desc("inspection_id")], 2, F.col("verdict").isNotNull())
    return store.rows().select("url", "inspection_id", "verdict", F.col(RUN).alias("run"))


@report(
    "index_monitor_due",
    f"""WITH {SNAPSHOTS}, known AS (SELECT concat('https://shop.example/u/', CAST(range AS VARCHAR)) AS url FROM range(0, 400)),
    s AS (SELECT url, max(inspected_at) AS last_attempt, max(inspected_at) FILTER (WHERE verdict IS NOT NULL) AS last_success FROM snapshots GROUP BY url),
    c AS (SELECT known.url, last_attempt, CASE WHEN last_attempt IS NULL THEN 'never-attempted' WHEN (last_success IS NULL OR last_success < last_attempt) AND last_attempt > TIMESTAMP '2024-01-30 00:00:00' THEN 'retry-waiting' WHEN last_success IS NULL THEN 'never-succeeded' WHEN last_success <= TIMESTAMP '2024-01-28 00:00:00' THEN 'stale' ELSE 'fresh' END AS class FROM known LEFT JOIN s USING (url))
    SELECT url, last_attempt, class FROM c WHERE class NOT IN ('retry-waiting', 'fresh') ORDER BY last_attempt NULLS FIRST, url LIMIT 100""",
)
def index_monitor_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that are due for inspection, those never tried first."""
    known = spark.range(400).select(F.concat(F.lit("https://shop.example/u/"), F.col("id").cast("string")).alias("url"))
    state = snapshots(spark, sf_dir).groupBy("url").agg(F.max("inspected_at").alias("last_attempt"), F.max(F.when(F.col("verdict").isNotNull(), F.col("inspected_at"))).alias("last_success"))
    attempt, success = F.col("last_attempt"), F.col("last_success")
    waiting = (success.isNull() | (success < attempt)) & (attempt > F.lit("2024-01-30").cast("timestamp"))
    kind = F.when(attempt.isNull(), "never-attempted").when(waiting, "retry-waiting").when(success.isNull(), "never-succeeded").when(success <= F.lit("2024-01-28").cast("timestamp"), "stale").otherwise("fresh")
    rows = known.join(state, "url", "left").select("url", "last_attempt", kind.alias("class")).filter(~F.col("class").isin("retry-waiting", "fresh"))
    return rows.orderBy(F.asc_nulls_first("last_attempt"), "url").limit(100)


@report(
    "index_watch",
    f"""WITH {SNAPSHOTS}, ok AS (SELECT *, lag(verdict) OVER (PARTITION BY url ORDER BY inspected_at, inspection_id) AS before_ FROM snapshots WHERE verdict IS NOT NULL),
    k AS (SELECT CASE WHEN before_ IS NULL THEN 'baseline' WHEN before_ = verdict THEN 'unchanged' WHEN verdict = 'FAIL' THEN 'regression' WHEN before_ = 'FAIL' THEN 'recovery' ELSE 'changed' END AS kind, url FROM ok)
    SELECT kind, count(*) AS n, count(DISTINCT url) AS n_urls FROM k GROUP BY kind""",
)
def index_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between successive verdicts of a URL."""
    before = F.lag("verdict").over(W.partitionBy("url").orderBy("inspected_at", "inspection_id"))
    rows = snapshots(spark, sf_dir).filter("verdict IS NOT NULL").withColumn("before", before)
    kind = F.when(F.col("before").isNull(), "baseline").when(F.col("before") == F.col("verdict"), "unchanged").when(F.col("verdict") == "FAIL", "regression").when(F.col("before") == "FAIL", "recovery").otherwise("changed")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@report(
    "repeat_offenders",
    f"""WITH {SNAPSHOTS}, runs AS (SELECT url, CAST(inspected_at AS DATE) AS run FROM snapshots WHERE verdict = 'FAIL'), last5 AS (SELECT DISTINCT CAST(inspected_at AS DATE) AS run FROM snapshots ORDER BY run DESC LIMIT 5)
    SELECT url, count(DISTINCT run) AS n_runs FROM runs WHERE run IN (SELECT run FROM last5) GROUP BY url HAVING count(DISTINCT run) >= 2""",
)
def repeat_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that fail in two of the last five runs at least."""
    rows = snapshots(spark, sf_dir).withColumn("run", F.to_date("inspected_at"))
    last = rows.select("run").distinct().orderBy(F.desc("run")).limit(5)
    return rows.filter("verdict = 'FAIL'").join(F.broadcast(last), "run", "left_semi").groupBy("url").agg(F.countDistinct("run").alias("n_runs")).filter("n_runs >= 2")  # five rows


@report(
    "rank_tracking",
    f"""WITH {SEARCH_ROWS}, runs AS (SELECT query AS keyword, year(date) AS run, min(position) AS position FROM search_rows GROUP BY 1, 2),
    cur AS (SELECT * FROM runs WHERE run = 1999), prev AS (SELECT * FROM runs WHERE run = 1998)
    SELECT coalesce(c.keyword, p.keyword) AS keyword, p.position::DOUBLE AS previous, c.position::DOUBLE AS current, CASE WHEN p.position IS NULL THEN 'new' WHEN c.position IS NULL THEN 'lost' WHEN p.position > c.position THEN 'improved' WHEN p.position < c.position THEN 'declined' ELSE 'unchanged' END AS change
    FROM cur c FULL OUTER JOIN prev p ON c.keyword = p.keyword""",
)
def rank_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best positions of two runs, side by side."""
    rows = search_rows(spark, sf_dir).groupBy(F.col("query").alias("keyword"), F.year("date").alias("run")).agg(F.min("position").cast("double").alias("position"))
    side = lambda year, name: rows.filter(F.col("run") == year).select("keyword", F.col("position").alias(name))
    both = side(1999, "current").join(side(1998, "previous"), "keyword", "full_outer")
    p, c = F.col("previous"), F.col("current")
    change = F.when(p.isNull(), "new").when(c.isNull(), "lost").when(p > c, "improved").when(p < c, "declined").otherwise("unchanged")
    return both.select("keyword", "previous", "current", change.alias("change"))


@report(
    "join_as_of",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1), c AS (SELECT * FROM d WHERE date >= DATE '2024-01-20')
    SELECT CAST(c.date AS VARCHAR) AS date, c.errors, CAST(p.date AS VARCHAR) AS before_date, p.errors AS before_errors FROM c ASOF LEFT JOIN d p ON c.date - 7 >= p.date""",
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day beside the last one a week or more before it; the union is sorted once, no row meets all others."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    asked = d.filter("date >= '2024-01-20'").select(F.date_sub("date", 7).alias("at"), F.lit(1).alias("kind"), "date", "errors")
    known = d.select(F.col("date").alias("at"), F.lit(0).alias("kind"), "date", "errors")
    seen = F.last(F.when(F.col("kind") == 0, F.struct("date", "errors")), ignorenulls=True).over(W.partitionBy(F.lit(1)).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))  # days: one row each
    return asked.union(known).withColumn("seen", seen).filter("kind = 1").select(F.col("date").cast("string"), "errors", F.col("seen.date").cast("string").alias("before_date"), F.col("seen.errors").alias("before_errors"))


@report(
    "competitor_keyword_gap",
    f"""WITH {SEARCH_ROWS}, {RANKED}, own AS (SELECT DISTINCT query FROM search_rows WHERE page LIKE '%/large/%' AND position <= 3), first AS (SELECT DISTINCT keyword FROM ranked WHERE domain = 'supplier-1.example'),
    comp AS (SELECT keyword, count(DISTINCT domain) AS n_competitors, min(rank) AS best_rank, sum(volume)::BIGINT AS volume, min_by(domain, struct_pack(a := rank, b := domain)) AS best_domain FROM ranked WHERE domain IN ('supplier-2.example', 'supplier-3.example', 'supplier-4.example', 'supplier-5.example') GROUP BY keyword),
    own_terms AS (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS term FROM own), comp_terms AS (SELECT DISTINCT keyword, unnest(string_split(keyword, ' ')) AS term FROM comp),
    overlap AS (SELECT keyword, max(k) AS k FROM (SELECT keyword, query, count(*) AS k FROM comp_terms JOIN own_terms USING (term) GROUP BY 1, 2) GROUP BY keyword)
    SELECT comp.keyword, n_competitors, best_rank, volume, best_domain, CASE WHEN own.query IS NOT NULL THEN 'already-observed' WHEN first.keyword IS NOT NULL THEN 'already-ranked' WHEN coalesce(k, 0) >= 2 AND (n_competitors >= 2 OR best_rank <= 10) THEN 'relevant' ELSE 'unverified' END AS class
    FROM comp LEFT JOIN own ON own.query = comp.keyword LEFT JOIN first ON first.keyword = comp.keyword LEFT JOIN overlap ON overlap.keyword = comp.keyword""",
)
def competitor_keyword_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that competitors rank for, by what is known of them on one's own side; relevant ones share two terms with an own query.

    Two keywords share two terms if they share a pair of terms, so pairs are looked up, however common single terms are.
    """
    ranked = ranked_keywords(spark, sf_dir)
    own = search_rows(spark, sf_dir).filter(F.col("page").contains("/large/") & (F.col("position") <= 3)).select("query").distinct()
    first = ranked.filter("domain = 'supplier-1.example'").select("keyword").distinct().withColumn("ranked", F.lit(True))
    rivals = [f"supplier-{i}.example" for i in range(2, 6)]
    comp = ranked.filter(F.col("domain").isin(rivals)).groupBy("keyword").agg(
        F.countDistinct("domain").alias("n_competitors"), F.min("rank").alias("best_rank"), F.sum("volume").alias("volume"), F.min_by("domain", F.struct("rank", "domain")).alias("best_domain")
    )
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    pairs = lambda c: F.flatten(F.transform(words(c), lambda a, i: F.transform(F.slice(words(c), i + 2, F.size(words(c))), lambda b: F.concat_ws(" ", a, b))))
    of_pairs = lambda df, c: df.select(c, F.explode(pairs(F.col(c))).alias("pair"))
    shared = of_pairs(comp, "keyword").join(of_pairs(own, "query").select("pair").distinct(), "pair", "left_semi").select("keyword").distinct().withColumn("related", F.lit(True))
    rows = comp.join(own.select(F.col("query").alias("keyword"), F.lit(True).alias("observed")), "keyword", "left").join(first, "keyword", "left").join(shared, "keyword", "left")
    kind = F.when(F.col("observed"), "already-observed").when(F.col("ranked"), "already-ranked").when(F.col("related") & ((F.col("n_competitors") >= 2) | (F.col("best_rank") <= 10)), "relevant").otherwise("unverified")
    return rows.select("keyword", "n_competitors", "best_rank", "volume", "best_domain", kind.alias("class"))


@report("serp_competitors", f"WITH {RANKED} SELECT domain, count(*) AS n_keywords, avg(rank) AS mean_rank, quantile_cont(rank, 0.5) AS median_rank, min(rank) AS best_rank FROM ranked GROUP BY domain")
def serp_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY rank)").alias("median_rank")
    return ranked_keywords(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n_keywords"), F.avg("rank").alias("mean_rank"), median, F.min("rank").alias("best_rank"))


@report(
    "ranking_distribution",
    f"WITH {RANKED} SELECT domain, count(*) FILTER (WHERE rank <= 3) AS top3, count(*) FILTER (WHERE rank BETWEEN 4 AND 10) AS top10, count(*) FILTER (WHERE rank BETWEEN 11 AND 20) AS top20, count(*) FILTER (WHERE rank > 20) AS rest FROM ranked GROUP BY domain",
)
def ranking_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda lo, hi, name: F.count_if(F.col("rank").between(lo, hi)).alias(name)
    return ranked_keywords(spark, sf_dir).groupBy("domain").agg(n(1, 3, "top3"), n(4, 10, "top10"), n(11, 20, "top20"), n(21, 1000, "rest"))


@report(
    "keyword_trend",
    """WITH m AS (SELECT p_name AS keyword, year(l_shipdate) * 12 + month(l_shipdate) AS month, sum(l_quantity::BIGINT)::BIGINT AS volume FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY month DESC) AS n FROM m), t AS (SELECT keyword, sum(volume) FILTER (WHERE n <= 3)::DOUBLE / 3 AS recent, sum(volume) FILTER (WHERE n BETWEEN 4 AND 6)::DOUBLE / 3 AS earlier, max(month) - min(month) FILTER (WHERE n <= 6) AS span, count(*) FILTER (WHERE n <= 6) AS k FROM r GROUP BY keyword)
    SELECT keyword, recent, earlier, CASE WHEN k < 6 OR span <> 5 THEN 'unknown' WHEN earlier = 0 THEN CASE WHEN recent = 0 THEN 'stable' ELSE 'increasing' END WHEN (recent - earlier) / earlier * 100.0 >= 10 THEN 'increasing' WHEN (recent - earlier) / earlier * 100.0 <= -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM t""",
)
def keyword_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three months against the three before, where six months follow each other."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.filter("l_shipdate >= '2000-01-01' AND l_shipdate < '2001-01-01'").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")
    m = rows.groupBy(F.col("p_name").alias("keyword"), month).agg(F.sum(F.col("l_quantity").cast("long")).alias("volume"))
    series = m.groupBy("keyword").agg(F.reverse(F.array_sort(F.collect_list(F.struct("month", "volume")))).alias("s")).withColumn("s", F.slice("s", 1, 6))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda t, x: t + x["volume"]).cast("double")
    mean = lambda a, n: F.when(F.size(F.slice("s", a, n)) > 0, total(F.slice("s", a, n)) / 3)
    whole = (F.size("s") == 6) & (F.element_at("s", 1)["month"] - F.element_at("s", -1)["month"] == 5)
    t = series.select("keyword", mean(1, 3).alias("recent"), mean(4, 3).alias("earlier"), whole.alias("whole"))
    change = (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100.0
    flat = F.when(F.col("recent") == 0, "stable").otherwise("increasing")
    trend = F.when(~F.col("whole"), "unknown").when(F.col("earlier") == 0, flat).when(change >= 10, "increasing").when(change <= -10, "decreasing").otherwise("stable")
    return t.select("keyword", "recent", "earlier", trend.alias("trend"))


@report(
    "bing_periods",
    """WITH w AS (SELECT user_id % 20 AS value, (DATE '2024-01-28' - CAST(ts AS DATE)) // 7 AS week, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS impressions FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-28' AND CAST(ts AS DATE) > DATE '2024-01-28' - 28 GROUP BY 1, 2),
    t AS (SELECT value, sum(clicks) FILTER (WHERE week < 2)::BIGINT AS clicks, sum(clicks) FILTER (WHERE week >= 2)::BIGINT AS previous_clicks, sum(impressions) FILTER (WHERE week < 2)::BIGINT AS impressions, sum(impressions) FILTER (WHERE week >= 2)::BIGINT AS previous_impressions, count(*) AS n_weeks FROM w GROUP BY value)
    SELECT value, clicks, previous_clicks, clicks - previous_clicks AS click_delta, impressions - previous_impressions AS impression_delta FROM t WHERE n_weeks = 4 ORDER BY abs(click_delta) DESC, abs(impression_delta) DESC, value LIMIT 10""",
)
def bing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two weeks against the two before, for values that all four weeks have."""
    end = F.lit("2024-01-28").cast("date")
    days = F.datediff(end, F.to_date("ts"))
    w = table(spark, sf_dir, "events").filter((days >= 0) & (days < 28)).groupBy((F.col("user_id") % 20).alias("value"), F.floor(days / 7).alias("week")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("impressions"))
    part = lambda c, on: F.sum(F.when((F.col("week") < 2) == on, F.col(c)))
    t = w.groupBy("value").agg(part("clicks", True).alias("clicks"), part("clicks", False).alias("previous_clicks"), part("impressions", True).alias("i"), part("impressions", False).alias("j"), F.count("*").alias("n_weeks"))
    t = t.filter("n_weeks = 4").select("value", "clicks", "previous_clicks", (F.col("clicks") - F.col("previous_clicks")).alias("click_delta"), (F.col("i") - F.col("j")).alias("impression_delta"))
    return t.orderBy(F.desc(F.abs("click_delta")), F.desc(F.abs("impression_delta")), "value").limit(10)


AI_SOURCES = [("chatgpt.com", "chatgpt"), ("openai.com", "chatgpt"), ("perplexity.ai", "perplexity"), ("claude.ai", "claude"), ("gemini.google.com", "gemini")]


@report(
    "ai_referrals",
    """WITH e AS (SELECT *, CASE user_id % 8 WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'www.perplexity.ai' WHEN 2 THEN 'chat.openai.com' WHEN 3 THEN 'claude.ai' WHEN 4 THEN 'google.com' ELSE '(direct)' END AS host FROM events),
    src(domain, id, ord) AS (VALUES ('chatgpt.com', 'chatgpt', 0), ('openai.com', 'chatgpt', 1), ('perplexity.ai', 'perplexity', 2), ('claude.ai', 'claude', 3), ('gemini.google.com', 'gemini', 4)),
    m AS (SELECT event_id, value, event_type, min_by(id, ord) AS source FROM e JOIN src ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1, 2, 3)
    SELECT source, count(*) AS sessions, count(*) FILTER (WHERE event_type = 'purchase') AS conversions, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM m GROUP BY source""",
)
def ai_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the AI product that they come from; a rule holds for its domain and all below, the first one wins."""
    hosts = ["chatgpt.com", "www.perplexity.ai", "chat.openai.com", "claude.ai", "google.com", "(direct)", "(direct)", "(direct)"]
    e = table(spark, sf_dir, "events").withColumn("host", F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("user_id") % 8 + 1).cast("int")))
    rules = spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate(AI_SOURCES)], "domain string, source string, ord int")
    named = domains_above(e, rules).groupBy("host").agg(F.min_by("source", "ord").alias("source"))
    t = e.join(named, "host").groupBy("source").agg(F.count("*").alias("sessions"), F.count_if(F.col("event_type") == "purchase").alias("conversions"))
    return t.withColumn("share", F.col("sessions") / F.sum("sessions").over(W.partitionBy(F.lit(1))))  # a row for each product


@report(
    "ai_referral_pages",
    """WITH e AS (SELECT concat('/p/', CAST(event_id % 40 AS VARCHAR)) AS path, CASE user_id % 8 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'perplexity' WHEN 2 THEN 'chatgpt' WHEN 3 THEN 'claude' END AS source FROM events),
    s AS (SELECT path, source, count(*) AS n FROM e WHERE source IS NOT NULL GROUP BY 1, 2)
    SELECT path, sum(n)::BIGINT AS sessions, arg_max(source, struct_pack(n := n, x := -ord)) AS top_source FROM (SELECT *, CASE source WHEN 'chatgpt' THEN 0 WHEN 'claude' THEN 1 ELSE 2 END AS ord FROM s) GROUP BY path""",
)
def ai_referral_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages with their sessions and the source that sends most."""
    names = F.array(*[F.lit(n) for n in ("chatgpt", "perplexity", "chatgpt", "claude")])
    at = (F.col("user_id") % 8 + 1).cast("int")
    e = table(spark, sf_dir, "events").filter(at <= 4).select(F.concat(F.lit("/p/"), (F.col("event_id") % 40).cast("string")).alias("path"), F.element_at(names, at).alias("source"))
    s = e.groupBy("path", "source").agg(F.count("*").alias("n"))
    return s.groupBy("path").agg(F.sum("n").alias("sessions"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_source"))


_PLAN_SQL = """urls AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION SELECT DISTINCT concat('https://shop.example/u/', user_id, '/', event_type) FROM events UNION SELECT DISTINCT concat('https://eu.shop.example/u/', user_id) FROM events),
    props AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^https?://[^/]*/[^/]*/') WHEN 1 THEN regexp_extract(url, '^https?://[^/]*/') WHEN 2 THEN concat('sc-domain:', regexp_extract(url, '([^./]*[.][^./]*)/', 1)) ELSE regexp_extract(url, '^https?://[^/]*/[^/]*/.') END AS property FROM pages
      UNION SELECT concat('https://shop.example/u/', c_custkey, '/') FROM customer UNION SELECT concat('https://shop.example/u/', c_custkey % 10) FROM customer UNION SELECT 'sc-domain:shop.example' UNION SELECT 'sc-domain:eu.shop.example'
      UNION SELECT 'https://')"""


def plan_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """URLs of the pages and of the users, and properties of both kinds made from the pages and the customers."""
    pages, events, customers = (table(spark, sf_dir, t) for t in ("pages", "events", "customer"))
    user, key = F.col("user_id").cast("string"), F.col("c_custkey").cast("string")
    urls = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    for u in (F.concat(F.lit("https://shop.example/u/"), user, F.lit("/"), "event_type"), F.concat(F.lit("https://eu.shop.example/u/"), user)):
        urls = urls.union(events.select(u))
    k, part = F.col("page_id") % 4, lambda p, i=0: F.regexp_extract("url", p, i)
    domain = F.concat(F.lit("sc-domain:"), part(r"([^./]*[.][^./]*)/", 1))
    named = F.when(k == 0, part("^https?://[^/]*/[^/]*/")).when(k == 1, part("^https?://[^/]*/")).when(k == 2, domain).otherwise(part("^https?://[^/]*/[^/]*/."))
    properties = pages.select(named.alias("property")).union(customers.select(F.concat(F.lit("https://shop.example/u/"), key, F.lit("/")))).union(customers.select(F.concat(F.lit("https://shop.example/u/"), (F.col("c_custkey") % 10).cast("string"))))
    fixed = spark.createDataFrame([("sc-domain:shop.example",), ("sc-domain:eu.shop.example",), ("https://",)], "property string")
    return urls.distinct(), properties.union(fixed).distinct()


@report(
    "index_plan",
    f"""WITH {_PLAN_SQL}, best AS (SELECT url, coalesce(
      (SELECT max_by(property, length(property)) FROM props WHERE NOT starts_with(property, 'sc-domain:') AND property <> '' AND starts_with(url, property)),
      (SELECT max_by(property, length(property)) FROM props WHERE starts_with(property, 'sc-domain:') AND ends_with('.' || regexp_extract(url, '^https?://([^/]*)', 1), '.' || substr(property, 11)))) AS property FROM urls)
    SELECT property, count(*) AS n_urls FROM best GROUP BY property""",
)
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by their most specific property, from a table of properties; null for those without one."""
    urls, properties = plan_tables(spark, sf_dir)
    return most_specific_property(urls, properties.filter("property <> ''")).groupBy("property").agg(F.count("*").alias("n_urls"))


@report(
    "geo_sessions",
    """WITH t AS (SELECT n_name AS country, r_name AS region, count(*) AS sessions, count(DISTINCT o_orderkey % 100) AS n_pages FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
    SELECT *, sessions::DOUBLE / sum(sessions) OVER () AS share FROM t""",
)
def geo_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and distinct pages by country, with the share of the total."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    t = rows.groupBy(F.col("n_name").alias("country"), F.col("r_name").alias("region")).agg(F.count("*").alias("sessions"), F.countDistinct(F.col("o_orderkey") % 100).alias("n_pages"))
    return t.withColumn("share", F.col("sessions") / F.sum("sessions").over(W.partitionBy(F.lit(1))))  # a row for each country
