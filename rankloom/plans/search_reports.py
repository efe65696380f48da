"""Reports over search rows: opportunities, cannibalisation, decay, segments, anomalies. Each takes tables and returns one flat table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import (
    curve_ctr, first_reason, is_brand, is_low_actionability, is_search_artifact, normal_query, page_key, page_template, percent_change, round_half_up, rounded_position, valid_search_row,
)
from ..operators.benchmark import benchmark_sql, leave_url_out
from ..operators.intervals import meeting_totals, overlapping
from ..operators.samples import with_first
from ..sources.views import QUERY_PAGE, SEARCH_DAILY, SEARCH_ROWS, aggregate_rows, query_page, query_page_table, search_daily, search_rows, table

BRAND = ["old hammer"]
_BRAND_SQL = "regexp_matches(lower(query), 'old[^a-z0-9]+hammers?') OR contains(replace(lower(query), ' ', ''), 'oldhammer')"
QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def striking_reason(least: int, brand: list[str]) -> Column:
    return first_reason(
        ("invalid", ~valid_search_row()),
        ("position", (F.col("position") <= 10) | (F.col("position") > 20)),
        ("impressions", F.col("impressions") < least),
        ("low_actionability", is_low_actionability(F.col("query"))),
        ("brand", is_brand(F.col("query"), brand)),
    )


def striking_distance_rows(rows: DataFrame, least_impressions: int = 100, brand: list[str] = BRAND) -> DataFrame:
    """Rows at positions over 10 up to 20, with a score of impressions times nearness to page one."""
    kept = rows.filter(striking_reason(least_impressions, brand).isNull())
    near = round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.1), (21 - F.col("position")) / 10)), 4)
    return kept.select("query", "page", "clicks", "impressions", "position", near.alias("proximity"), round_half_up(F.col("impressions") * near, 2).alias("score"))


_STRIKING = (
    QUERY_PAGE
    + f""",
striking AS (
  SELECT query, page, clicks, impressions, position, floor(least(1.0, greatest(0.1, (21 - position) / 10)) * 10000 + 0.5) / 10000 AS proximity FROM query_page
  WHERE position > 10 AND position <= 20 AND impressions >= 100 AND NOT ({_BRAND_SQL})),
scored AS (SELECT *, floor(impressions * proximity * 100 + 0.5) / 100 AS score FROM striking)"""
)


@report("striking_distance", f"WITH {_STRIKING} SELECT * FROM scored ORDER BY score DESC, impressions DESC, position, query, page LIMIT 25")
def striking_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = striking_distance_rows(query_page(spark, sf_dir))
    return rows.orderBy(F.desc("score"), F.desc("impressions"), "position", "query", "page").limit(25)


@report(
    "striking_groups",
    f"""WITH {_STRIKING} SELECT concat('/', split_part(page, '/', 4), '/') AS template, count(*) AS n_rows, count(DISTINCT page) AS n_pages, count(DISTINCT query) AS n_queries,
    min(position) AS best_position, sum(impressions)::BIGINT AS impressions FROM scored GROUP BY 1""",
)
def striking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = striking_distance_rows(query_page(spark, sf_dir))
    return rows.groupBy(page_template(F.col("page")).alias("template")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("page").alias("n_pages"), F.countDistinct("query").alias("n_queries"), F.min("position").alias("best_position"), F.sum("impressions").alias("impressions")
    )


@report(
    "funnel_counters",
    f"""WITH {QUERY_PAGE} SELECT coalesce(CASE WHEN position <= 10 OR position > 20 THEN 'position' WHEN impressions < 100 THEN 'impressions' WHEN {_BRAND_SQL} THEN 'brand' END, 'kept') AS reason,
    count(*) AS n_rows, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1""",
)
def funnel_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first reason that rejects them."""
    reason = F.coalesce(striking_reason(100, BRAND), F.lit("kept")).alias("reason")
    return query_page(spark, sf_dir).groupBy(reason).agg(F.count("*").alias("n_rows"), F.sum("impressions").alias("impressions"))


@report(
    "second_page",
    f"""WITH {_STRIKING.replace('impressions >= 100 AND ', '')}, pages AS (
  SELECT page, count(*) AS n_queries, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(floor(position * 100 + 0.5) * impressions)::DOUBLE / 100 / sum(impressions)::DOUBLE AS position,
    max_by(query, struct_pack(a := impressions, b := -position, c := clicks, d := query)) AS top_query FROM scored GROUP BY page HAVING sum(impressions) >= 50)
  SELECT * FROM pages ORDER BY impressions DESC, position, page LIMIT 10""",
)
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with queries on the second result page; the queries' positions are rounded before they are averaged."""
    ok = valid_search_row() & (F.col("position") > 10) & (F.col("position") <= 20) & ~is_brand(F.col("query"), BRAND)
    rows = query_page(spark, sf_dir).filter(ok)
    total = F.sum("impressions").cast("double")
    pages = rows.groupBy("page").agg(
        F.count("*").alias("n_queries"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        (F.sum(F.floor(F.col("position") * 100 + 0.5) * F.col("impressions")).cast("double") / 100 / total).alias("position"),
        F.max_by("query", F.struct("impressions", -F.col("position"), "clicks", "query")).alias("top_query"),
    )
    return pages.filter("impressions >= 50").orderBy(F.desc("impressions"), "position", "page").limit(10)


def with_target(rows: DataFrame, population: DataFrame, all_qualified: bool) -> DataFrame:
    """rows with the benchmark of their page and position."""
    bench = leave_url_out(population, all_qualified).select("url_key", "bucket", "target")
    keyed = rows.withColumn("url_key", page_key(F.col("page"))).withColumn("bucket", rounded_position(F.col("position")))
    return keyed.join(bench, ["url_key", "bucket"])


def quick_win_rows(rows: DataFrame, least_impressions: int = 200) -> DataFrame:
    """Rows at positions 4 to 10 whose rate is under the benchmark, with the clicks that they fall short."""
    population = rows.filter(valid_search_row(min_position=1) & (F.col("position") <= 10) & ~is_low_actionability(F.col("query")) & ~is_brand(F.col("query"), BRAND))
    found = with_target(population.filter((F.col("position") >= 4) & (F.col("impressions") >= least_impressions)), population, True).filter("ctr < target")
    short = round_half_up((F.col("target") - F.col("ctr")) * F.col("impressions"), 2)
    return found.select("query", "page", "clicks", "impressions", "position", "ctr", "target", short.alias("shortfall"))


_POPULATION = QUERY_PAGE + f""", population AS (SELECT * FROM query_page WHERE position >= 1 AND position <= 10 AND NOT ({_BRAND_SQL})),"""
_QUICK = (
    _POPULATION
    + benchmark_sql("population", True)
    + """,
quick AS (
  SELECT query, page, clicks, impressions, position, ctr, target, floor((target - ctr) * impressions * 100 + 0.5) / 100 AS shortfall
  FROM population p JOIN bench b ON b.url_key = p.page AND b.bucket = greatest(1, least(10, floor(p.position + 0.5)))::INT
  WHERE position >= 4 AND impressions >= 200 AND ctr < target)"""
)


@report("quick_wins", f"WITH {_QUICK} SELECT * FROM quick ORDER BY shortfall DESC, impressions DESC, query, page LIMIT 25")
def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quick_win_rows(query_page_table(spark, sf_dir)).orderBy(F.desc("shortfall"), F.desc("impressions"), "query", "page").limit(25)


@report(
    "quick_win_groups",
    f"""WITH {_QUICK} SELECT concat('/', split_part(page, '/', 4), '/') AS template, query, count(DISTINCT page) AS n_pages, sum(impressions)::BIGINT AS impressions FROM quick GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""",
)
def quick_win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quick_win_rows(query_page_table(spark, sf_dir))
    groups = rows.groupBy(page_template(F.col("page")).alias("template"), "query").agg(F.countDistinct("page").alias("n_pages"), F.sum("impressions").alias("impressions"))
    return groups.filter("n_pages >= 2")


@report("ctr_benchmark", f"WITH {_POPULATION} {benchmark_sql('population', False)} SELECT url_key, bucket, target, from_site FROM bench")
def ctr_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_page_table(spark, sf_dir).filter((F.col("position") >= 1) & (F.col("position") <= 10) & ~is_brand(F.col("query"), BRAND))
    return leave_url_out(rows)


@report(
    "ctr_underperformers",
    f"""WITH {_POPULATION} {benchmark_sql('population', False)}
  SELECT query, page, clicks, impressions, position, ctr, target, greatest(0, target * impressions - clicks) AS shortfall
  FROM population p JOIN bench b ON b.url_key = p.page AND b.bucket = greatest(1, least(10, floor(p.position + 0.5)))::INT
  WHERE impressions >= 200 AND ctr < 0.6 * target ORDER BY shortfall DESC, query, page LIMIT 25""",
)
def ctr_underperformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reach under 60 % of the benchmark."""
    population = query_page_table(spark, sf_dir).filter(valid_search_row() & F.col("position").between(1, 10) & ~is_low_actionability(F.col("query")) & ~is_brand(F.col("query"), BRAND))
    found = with_target(population.filter("impressions >= 200"), population, False).filter("ctr < 0.6 * target")
    short = F.greatest(F.lit(0.0), F.col("target") * F.col("impressions") - F.col("clicks"))
    return found.select("query", "page", "clicks", "impressions", "position", "ctr", "target", short.alias("shortfall")).orderBy(F.desc("shortfall"), "query", "page").limit(25)


@report(
    "page_opportunities",
    f"""WITH {QUERY_PAGE}, mine AS (SELECT * FROM query_page WHERE page = 'https://shop.example/small/supplier-3' AND impressions >= 10 AND NOT ({_BRAND_SQL})),
  others AS (SELECT * FROM query_page WHERE position >= 1 AND position <= 10 AND page <> 'https://shop.example/small/supplier-3' OR page = 'https://shop.example/small/supplier-3' AND position >= 1 AND position <= 10),
  {benchmark_sql('others', False)}
  SELECT query, impressions, position, CASE WHEN position > 10 THEN 'ranking' WHEN ctr < 0.65 * target THEN 'ctr' ELSE 'covered' END AS kind,
    CASE WHEN position <= 10 THEN greatest(0, target - ctr) * impressions END AS shortfall
  FROM mine LEFT JOIN bench ON bench.url_key = mine.page AND bench.bucket = greatest(1, least(10, floor(position + 0.5)))::INT AND position <= 10
  ORDER BY coalesce(shortfall, -1) DESC, impressions DESC, position, query LIMIT 25""",
)
def page_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of one page, held against the rates of all other pages."""
    rows, target = query_page_table(spark, sf_dir), "https://shop.example/small/supplier-3"
    mine = rows.filter(valid_search_row() & (F.col("page") == target) & (F.col("impressions") >= 10) & ~is_low_actionability(F.col("query")) & ~is_brand(F.col("query"), BRAND))
    bench = leave_url_out(rows.filter(F.col("position").between(1, 10))).select("url_key", "bucket", "target")
    bucket = F.when(F.col("position") <= 10, rounded_position(F.col("position")))
    keyed = mine.withColumn("url_key", page_key(F.col("page"))).withColumn("bucket", bucket).join(bench, ["url_key", "bucket"], "left")
    kind = F.when(F.col("position") > 10, "ranking").when(F.col("ctr") < 0.65 * F.col("target"), "ctr").otherwise("covered")
    short = F.when(F.col("position") <= 10, F.greatest(F.lit(0.0), F.col("target") - F.col("ctr")) * F.col("impressions")).alias("shortfall")
    return keyed.select("query", "impressions", "position", kind.alias("kind"), short).orderBy(F.desc(F.coalesce("shortfall", F.lit(-1.0))), F.desc("impressions"), "position", "query").limit(25)


@report(
    "cannibalisation",
    f"""WITH {QUERY_PAGE}, q AS (SELECT *, sum(impressions) OVER (PARTITION BY query) AS demand, count(*) OVER (PARTITION BY query) AS n_pages FROM query_page WHERE NOT ({_BRAND_SQL})),
  material AS (SELECT *, impressions::DOUBLE / sum(impressions) OVER (PARTITION BY query) AS share FROM (SELECT * FROM q WHERE demand >= 50 AND n_pages >= 2 AND impressions >= 10 AND impressions::DOUBLE / demand >= 0.02)),
  r AS (SELECT *, floor(share * 10000 + 0.5) / 10000 AS s FROM material),
  g AS (SELECT query, any_value(demand)::BIGINT AS demand, count(*) AS n_material, floor(sum(floor(s * 10000 + 0.5) * floor(s * 10000 + 0.5)) + 0.5) / 1e8 AS hhi, max(s) AS top_share,
    max_by(page, struct_pack(a := clicks, b := impressions, c := -position)) AS owner FROM r GROUP BY query HAVING count(*) >= 2 AND max(s) <= 0.8)
  SELECT query, demand, n_material, hhi, owner, floor(demand * (1 - top_share) * 1000 + 0.5) / 1000 AS priority FROM g ORDER BY priority DESC, demand DESC, query LIMIT 25""",
)
def cannibalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose impressions are split between pages, with the concentration of the split and the page that owns the query."""
    whole = W.partitionBy("query")
    rows = query_page(spark, sf_dir).filter(~is_low_actionability(F.col("query")) & ~is_brand(F.col("query"), BRAND))
    rows = rows.withColumn("demand", F.sum("impressions").over(whole)).withColumn("n_pages", F.count("*").over(whole))
    material = rows.filter("demand >= 50 AND n_pages >= 2 AND impressions >= 10").filter(F.col("impressions").cast("double") / F.col("demand") >= 0.02)
    s = round_half_up(F.col("impressions").cast("double") / F.sum("impressions").over(whole), 4)
    points = F.floor(F.col("s") * 10000 + 0.5)
    found = material.withColumn("s", s).groupBy("query").agg(
        F.first("demand").alias("demand"), F.count("*").alias("n_material"), (F.sum(points * points) / 1e8).alias("hhi"), F.max("s").alias("top_share"),
        F.max_by("page", F.struct("clicks", "impressions", -F.col("position"))).alias("owner"),
    )
    found = found.filter("n_material >= 2 AND top_share <= 0.8").withColumn("priority", round_half_up(F.col("demand") * (1 - F.col("top_share")), 3))
    return found.select("query", "demand", "n_material", "hhi", "owner", "priority").orderBy(F.desc("priority"), F.desc("demand"), "query").limit(25)


BEFORE, AFTER = ("1996-01-01", "1997-12-31"), ("1998-01-01", "1999-12-31")


def windows(spark: SparkSession, sf_dir: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows of two adjacent windows, aggregated by keys."""
    rows = search_rows(spark, sf_dir)
    return tuple(aggregate_rows(rows.filter(F.col("date").between(*w)), *keys) for w in (BEFORE, AFTER))


def _windows_sql(*keys: str) -> str:
    k = ", ".join(keys)
    agg = "sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, sum(position * impressions)::DOUBLE / sum(impressions)::DOUBLE AS position, sum(clicks)::DOUBLE / sum(impressions)::DOUBLE AS ctr"
    return SEARCH_ROWS + "".join(f", {n} AS (SELECT {k}, {agg} FROM search_rows WHERE date BETWEEN '{a}' AND '{b}' GROUP BY {k})" for n, (a, b) in (("prev", BEFORE), ("cur", AFTER)))


def decay_rows(prev: DataFrame, cur: DataFrame, least_drop: float = 20, least_previous: int = 2, least_loss: int = 1) -> DataFrame:
    """Every (query, page) of the previous window with why its clicks fell, or why it isn't counted."""
    c = cur.select("query", "page", *[F.col(x).alias(f"cur_{x}") for x in ("clicks", "impressions", "position", "ctr")])
    elsewhere = cur.select("query").distinct().withColumn("elsewhere", F.lit(True))
    rows = prev.join(c, ["query", "page"], "left").join(elsewhere, "query", "left")
    loss = F.col("clicks") - F.col("cur_clicks")
    reason = first_reason(
        ("below_minimum", (F.col("clicks") <= 0) | (F.col("clicks") < least_previous)),
        ("artifact", is_search_artifact(F.col("query"))),
        ("brand", is_brand(F.col("query"), BRAND)),
        ("url_shift", F.col("cur_clicks").isNull() & F.coalesce("elsewhere", F.lit(False))),
        ("not_retained", F.col("cur_clicks").isNull()),
        ("no_loss", (loss <= 0) | (loss < least_loss)),
        ("small_drop", loss * 100.0 / F.col("clicks") < least_drop),
    )
    diagnosis = (
        F.when(F.col("cur_position") > F.col("position") + 1, "lost_position")
        .when((F.col("cur_impressions") >= 0.9 * F.col("impressions")) & (F.col("cur_ctr") < 0.8 * F.col("ctr")), "lost_ctr")
        .when(F.col("cur_impressions") < 0.9 * F.col("impressions"), "lost_impressions")
        .otherwise("lost_clicks")
    )
    return rows.select("query", "page", F.col("clicks").alias("previous_clicks"), "cur_clicks", loss.alias("loss"), reason.alias("reason"), diagnosis.alias("diagnosis"))


_DECAY = (
    _windows_sql("query", "page")
    + f""", decay AS (SELECT p.query, p.page, p.clicks AS previous_clicks, c.clicks AS cur_clicks, p.clicks - c.clicks AS loss,
  CASE WHEN p.clicks < 2 THEN 'below_minimum' WHEN {_BRAND_SQL.replace('query', 'p.query')} THEN 'brand' WHEN c.query IS NULL AND e.query IS NOT NULL THEN 'url_shift' WHEN c.query IS NULL THEN 'not_retained'
    WHEN p.clicks - c.clicks < 1 THEN 'no_loss' WHEN (p.clicks - c.clicks) * 100.0::DOUBLE / p.clicks < 20 THEN 'small_drop' END AS reason,
  CASE WHEN c.position > p.position + 1 THEN 'lost_position' WHEN c.impressions >= 0.9::DOUBLE * p.impressions AND c.ctr < 0.8::DOUBLE * p.ctr THEN 'lost_ctr' WHEN c.impressions < 0.9::DOUBLE * p.impressions THEN 'lost_impressions' ELSE 'lost_clicks' END AS diagnosis
  FROM prev p LEFT JOIN cur c ON c.query = p.query AND c.page = p.page LEFT JOIN (SELECT DISTINCT query FROM cur) e ON e.query = p.query)"""
)


@report("decaying_pages", f"WITH {_DECAY} SELECT query, page, previous_clicks, cur_clicks, loss, diagnosis FROM decay WHERE reason IS NULL ORDER BY loss DESC, previous_clicks DESC, query, page LIMIT 25")
def decaying_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decay_rows(*windows(spark, sf_dir, "query", "page")).filter("reason IS NULL").drop("reason")
    return rows.orderBy(F.desc("loss"), F.desc("previous_clicks"), "query", "page").limit(25)


@report("decay_funnel", f"WITH {_DECAY} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM decay GROUP BY 1")
def decay_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decay_rows(*windows(spark, sf_dir, "query", "page"))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_rows"))


@report(
    "decay_groups",
    f"""WITH {_DECAY} SELECT concat('/', split_part(page, '/', 4), '/') AS template, diagnosis, count(*) AS n_rows, sum(loss)::BIGINT AS loss, sum(loss)::DOUBLE * 100 / sum(previous_clicks)::DOUBLE AS loss_percent,
    list_sort(list(DISTINCT page))[1:3] AS samples FROM decay WHERE reason IS NULL GROUP BY 1, 2""",
)
def decay_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decay_rows(*windows(spark, sf_dir, "query", "page")).filter("reason IS NULL").withColumn("template", page_template(F.col("page")))
    total = F.sum("loss").cast("double") * 100 / F.sum("previous_clicks").cast("double")
    groups = rows.groupBy("template", "diagnosis").agg(F.count("*").alias("n_rows"), F.sum("loss").alias("loss"), total.alias("loss_percent"))
    return with_first(groups, rows, ["template", "diagnosis"], "page", 3, "samples")


def segment_impact_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Segments of two windows side by side. A segment that one window lacks stays null there: missing isn't zero."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("clicks", "impressions", "position")])
    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    retained = F.when(F.col("after_clicks").isNull(), "before").when(F.col("before_clicks").isNull(), "after").otherwise("both")
    return both.select(F.col(key).alias("segment"), "before_clicks", "after_clicks", "before_impressions", "after_impressions", (F.col("after_clicks") - F.col("before_clicks")).alias("click_delta"), retained.alias("retained_in"))


_SEGMENT = """, seg AS (SELECT coalesce(p.{k}, c.{k}) AS segment, p.clicks AS before_clicks, c.clicks AS after_clicks, p.impressions AS before_impressions, c.impressions AS after_impressions, c.clicks - p.clicks AS click_delta,
  CASE WHEN c.clicks IS NULL THEN 'before' WHEN p.clicks IS NULL THEN 'after' ELSE 'both' END AS retained_in FROM prev p FULL OUTER JOIN cur c ON c.{k} = p.{k})"""


@report("segment_impact", f"WITH {_windows_sql('page')} {_SEGMENT.format(k='page')} SELECT *, after_clicks * 100.0::DOUBLE / nullif(before_clicks, 0) - 100.0 AS percent FROM seg WHERE retained_in = 'both' ORDER BY abs(click_delta) DESC, segment LIMIT 25")
def segment_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_impact_rows(*windows(spark, sf_dir, "page"), "page").filter("retained_in = 'both'")
    change = F.col("after_clicks") * F.lit(100.0) / F.nullif("before_clicks", F.lit(0)) - 100.0
    return rows.withColumn("percent", change).orderBy(F.desc(F.abs("click_delta")), "segment").limit(25)


@report("segment_unmatched", f"WITH {_windows_sql('query', 'page').replace('query, page,', 'concat(query, page) AS k,').replace('GROUP BY query, page', 'GROUP BY 1')} {_SEGMENT.format(k='k')} SELECT segment, coalesce(before_clicks, after_clicks) AS clicks, retained_in FROM seg WHERE retained_in <> 'both'")
def segment_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that only one window has."""
    key = F.concat("query", "page").alias("k")
    both = [w.select(key, "clicks", "impressions", "position") for w in windows(spark, sf_dir, "query", "page")]
    rows = segment_impact_rows(*both, "k").filter("retained_in <> 'both'")
    return rows.select("segment", F.coalesce("before_clicks", "after_clicks").alias("clicks"), "retained_in")


def anomalies(daily: DataFrame, recent_days: int = 7) -> DataFrame:
    """Per metric, the last days against those before: z is (mean - mean) / (population deviation / sqrt(days)), null on a flat base."""
    last = daily.agg(F.max("date").alias("last"))
    long_ = daily.join(F.broadcast(last), F.col("date") <= F.col("last")).select(  # one row
        (F.col("date") > F.date_sub("last", recent_days)).alias("recent"), F.explode(F.map_from_arrays(F.array(F.lit("clicks"), F.lit("impressions")), F.array("clicks", "impressions"))).alias("metric", "value")
    )
    recent, base = F.when(F.col("recent"), F.col("value")), F.when(~F.col("recent"), F.col("value"))
    stats = long_.groupBy("metric").agg(F.avg(recent).alias("recent_mean"), F.avg(base).alias("base_mean"), F.stddev_pop(base).alias("deviation"), F.count(recent).alias("n_recent"), F.count(base).alias("n_base"))
    z = F.when(F.col("deviation") > 0, (F.col("recent_mean") - F.col("base_mean")) / (F.col("deviation") / F.sqrt("n_recent")))
    significant = F.coalesce(F.abs("z") >= 2, F.col("recent_mean") != F.col("base_mean"))
    out = stats.filter("n_base >= 14 AND n_recent >= 3").withColumn("z", z).withColumn("significant", significant)
    direction = F.when(~F.col("significant"), "normal").when(F.col("recent_mean") < F.col("base_mean"), "drop").otherwise("spike")
    return out.select("metric", "recent_mean", "base_mean", "n_recent", "n_base", round_half_up(F.col("z"), 3).alias("z"), "significant", direction.alias("direction"))


_ANOMALY = SEARCH_DAILY + """, long AS (SELECT date, 'clicks' AS metric, clicks AS value FROM search_daily UNION ALL SELECT date, 'impressions', impressions FROM search_daily),
  stats AS (SELECT metric, avg(value) FILTER (WHERE date > last - 7) AS recent_mean, avg(value) FILTER (WHERE date <= last - 7) AS base_mean, stddev_pop(value) FILTER (WHERE date <= last - 7) AS deviation,
    count(*) FILTER (WHERE date > last - 7) AS n_recent, count(*) FILTER (WHERE date <= last - 7) AS n_base FROM long, (SELECT max(date) AS last FROM search_daily) GROUP BY metric),
  zs AS (SELECT *, CASE WHEN deviation > 0 THEN (recent_mean - base_mean) / (deviation / sqrt(n_recent)) END AS zz FROM stats WHERE n_base >= 14 AND n_recent >= 3),
  anomaly AS (SELECT metric, recent_mean, base_mean, n_recent, n_base, floor(zz * 1000 + 0.5) / 1000 AS z, coalesce(abs(zz) >= 2, recent_mean <> base_mean) AS significant,
    CASE WHEN NOT coalesce(abs(zz) >= 2, recent_mean <> base_mean) THEN 'normal' WHEN recent_mean < base_mean THEN 'drop' ELSE 'spike' END AS direction FROM zs)"""


@report("traffic_anomaly", f"WITH {_ANOMALY} SELECT * FROM anomaly")
def traffic_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(search_daily(spark, sf_dir))


_UPDATES_SQL = """updates AS (SELECT n_name AS id, DATE '2023-12-15' + (n_nationkey * 2)::INT AS begin_, CASE WHEN n_regionkey < 4 THEN DATE '2023-12-15' + (n_nationkey * 2 + n_regionkey * 3)::INT END AS end_ FROM nation)"""


def official_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """update_id, begin and until of announced updates, a fixture over the nations; those of one region are still open."""
    n = table(spark, sf_dir, "nation")
    begin = F.date_add(F.lit("2023-12-15").cast("date"), (F.col("n_nationkey") * 2).cast("int"))
    return n.select(F.col("n_name").alias("update_id"), begin.alias("begin"), F.when(F.col("n_regionkey") < 4, F.date_add(begin, (F.col("n_regionkey") * 3).cast("int"))).alias("until"))


@report(
    "update_correlation",
    f"""WITH {_ANOMALY}, {_UPDATES_SQL} SELECT metric, direction, id AS update_id, CASE WHEN significant AND id IS NOT NULL THEN 'movement-with-overlap' WHEN significant THEN 'movement-without-overlap' WHEN id IS NOT NULL THEN 'overlap-without-movement' ELSE 'none' END AS classification
    FROM anomaly LEFT JOIN updates ON begin_ <= DATE '2024-01-30' + 3 AND coalesce(end_, DATE '2024-02-01') >= DATE '2024-01-24' - 3""",
)
def update_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies beside the official updates of their time; an overlap establishes no cause."""
    found = anomalies(search_daily(spark, sf_dir))
    recent = found.select("metric", F.lit("2024-01-24").cast("date").alias("start"), F.lit("2024-01-30").cast("date").alias("end"))
    met = overlapping(recent, official_updates(spark, sf_dir), F.lit("2024-02-01").cast("date"), 3).select("metric", "update_id")
    both = found.join(met, "metric", "left")
    kind = F.when(F.col("significant") & F.col("update_id").isNotNull(), "movement-with-overlap").when(F.col("significant"), "movement-without-overlap").when(F.col("update_id").isNotNull(), "overlap-without-movement").otherwise("none")
    return both.select("metric", "direction", "update_id", kind.alias("classification"))


#: The day up to which open intervals last.
_TODAY = "1999-06-01"


def supplier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, start and end: four weeks before and after a day of each supplier."""
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), day.alias("d"))
    name = lambda side: F.concat(F.lit(f"{side} "), "k").alias("name")
    return s.select(name("before"), F.date_sub("d", 28).alias("start"), F.date_sub("d", 1).alias("end")).union(s.select(name("after"), F.col("d"), F.date_add("d", 27)))


_WINDOWS_OF = """d AS (SELECT s_suppkey AS k, DATE '1996-01-01' + (s_suppkey * 37 % 1500)::INT AS d FROM supplier),
  w AS (SELECT concat('before ', k) AS name, d - 28 AS a, d - 1 AS b FROM d UNION ALL SELECT concat('after ', k), d, d + 27 FROM d)"""


@report(
    "update_overlaps",
    f"""WITH {_WINDOWS_OF}, o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS x, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + (o_orderkey % 7 * o_orderkey % 200)::INT END AS y, o_orderstatus = 'O' AS open_ FROM orders WHERE o_orderpriority = '1-URGENT'),
  m AS (SELECT name, id, open_ FROM w JOIN o ON x - 3 <= b AND coalesce(y, DATE '{_TODAY}') + 3 >= a AND x - 3 <= coalesce(y, DATE '{_TODAY}') + 3)
  SELECT name, count(id) AS n_updates, count(*) FILTER (WHERE open_) AS n_open, min(id)::BIGINT AS first_update FROM m GROUP BY name""",
)
def update_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many urgent orders, open ones until a fixed day, lie within three days of each supplier's windows."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    key, begin = F.col("o_orderkey"), F.to_date("o_orderdate")
    ended = F.when(F.col("o_orderstatus") != "O", F.date_add(begin, (key % 7 * key % 200).cast("int")))
    one = lambda c, name: c.cast("long").alias(name)
    orders = o.select(key.alias("first_update"), begin.alias("begin"), ended.alias("until"), one(F.lit(1), "n_rows"), one(key.isNotNull(), "n_updates"), one(F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)), "n_open"))
    met = meeting_totals(supplier_windows(spark, sf_dir), orders, F.lit(_TODAY).cast("date"), 3, ("n_rows", "n_updates", "n_open"), ("first_update",)).filter("n_rows > 0")
    return met.groupBy("name").agg(F.sum("n_updates").alias("n_updates"), F.sum("n_open").alias("n_open"), F.min("first_update").cast("long").alias("first_update"))


@report(
    "measure_change",
    f"""WITH {_windows_sql('page')}, grp AS (SELECT page, CASE WHEN page LIKE '%supplier-1' OR page LIKE '%supplier-2' THEN 'changed' ELSE 'control' END AS g FROM (SELECT page FROM prev UNION SELECT page FROM cur)),
  t AS (SELECT g, sum(p.clicks)::BIGINT AS before_clicks, sum(c.clicks)::BIGINT AS after_clicks, sum(p.impressions)::BIGINT AS before_impressions, sum(c.impressions)::BIGINT AS after_impressions
    FROM grp LEFT JOIN prev p USING (page) LEFT JOIN cur c USING (page) GROUP BY g)
  SELECT x.before_clicks, x.after_clicks, CASE WHEN x.before_clicks <> 0 THEN (x.after_clicks - x.before_clicks)::DOUBLE / x.before_clicks * 100 END AS change_percent,
    CASE WHEN k.before_clicks > 0 THEN x.after_clicks - x.before_clicks * (k.after_clicks::DOUBLE / k.before_clicks) END AS counterfactual_delta,
    CASE WHEN least(x.before_impressions, x.after_impressions) < 100 THEN 'not-enough-data' WHEN abs((x.after_clicks - x.before_clicks)::DOUBLE / x.before_clicks) < 0.1 THEN 'no-clear-change' WHEN x.after_clicks > x.before_clicks THEN 'improved' ELSE 'declined' END AS verdict
  FROM t x, t k WHERE x.g = 'changed' AND k.g = 'control'""",
)
def measure_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change on some pages, before and after, against what the other pages did at the same time."""
    changed = F.col("page").rlike("supplier-[12]$")
    before, after = windows(spark, sf_dir, "page")
    total = lambda df, p: df.agg(*[F.sum(F.when(changed == on, F.col(c))).alias(f"{p}_{c}_{n}") for c in ("clicks", "impressions") for on, n in ((True, "x"), (False, "k"))])
    t = total(before, "b").withColumn("one", F.lit(1)).join(total(after, "a").withColumn("one", F.lit(1)), "one")  # one row each
    b, a, kb, ka = (F.col(c) for c in ("b_clicks_x", "a_clicks_x", "b_clicks_k", "a_clicks_k"))
    verdict = (
        F.when(F.least("b_impressions_x", "a_impressions_x") < 100, "not-enough-data").when(F.abs((a - b) / b) < 0.1, "no-clear-change").when(a > b, "improved").otherwise("declined")
    )
    return t.select(b.alias("before_clicks"), a.alias("after_clicks"), percent_change(b, a).alias("change_percent"), F.when(kb > 0, a - b * (ka / kb)).alias("counterfactual_delta"), verdict.alias("verdict"))


@report(
    "update_postmortem",
    f"""WITH {_windows_sql('query', 'page')}, moved AS (SELECT p.page, p.query, c.clicks - p.clicks AS delta FROM prev p JOIN cur c USING (query, page) WHERE c.clicks <> p.clicks),
  t AS (SELECT concat('/', split_part(page, '/', 4), '/') AS template, CASE WHEN delta > 0 THEN 'winner' ELSE 'loser' END AS direction, count(*) AS n_rows, count(DISTINCT page) AS n_pages, sum(delta)::BIGINT AS delta FROM moved GROUP BY 1, 2)
  SELECT *, n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY template) AS share FROM t WHERE n_pages >= 3""",
)
def update_postmortem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which templates won and lost between two windows."""
    before, after = windows(spark, sf_dir, "query", "page")
    both = before.select("query", "page", F.col("clicks").alias("b")).join(after.select("query", "page", F.col("clicks").alias("a")), ["query", "page"]).withColumn("delta", F.col("a") - F.col("b")).filter("delta <> 0")
    direction = F.when(F.col("delta") > 0, "winner").otherwise("loser").alias("direction")
    t = both.groupBy(page_template(F.col("page")).alias("template"), direction).agg(F.count("*").alias("n_rows"), F.countDistinct("page").alias("n_pages"), F.sum("delta").alias("delta")).filter("n_pages >= 3")
    return t.withColumn("share", F.col("n_rows").cast("double") / F.sum("n_rows").over(W.partitionBy("template")))


@report("top_query_per_page", f"WITH {QUERY_PAGE} SELECT page, query, clicks, impressions FROM query_page QUALIFY row_number() OVER (PARTITION BY page ORDER BY clicks DESC, impressions DESC, query) = 1")
def top_query_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("page").orderBy(F.desc("clicks"), F.desc("impressions"), "query")
    return query_page(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter("n = 1").select("page", "query", "clicks", "impressions")


@report("percentile_nearest_rank", f"WITH {QUERY_PAGE} SELECT query, quantile_disc(ctr, 0.75) AS p75, count(*) AS n FROM query_page GROUP BY query")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_page(spark, sf_dir).groupBy("query").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY ctr)").alias("p75"), F.count("*").alias("n"))


@report(
    "dedupe_conflicts",
    """WITH r AS (SELECT l_orderkey AS k, l_returnflag AS v FROM lineitem), g AS (SELECT k, count(DISTINCT v) AS kinds, count(*) AS n, min(v) AS v FROM r GROUP BY k)
    SELECT k, v, n FROM g WHERE kinds = 1""",
)
def dedupe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical rows of a key are one; keys whose rows differ go altogether. All rows count."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("v"))
    g = r.groupBy("k").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.count("*").alias("n"))
    return g.filter("v = w").select("k", "v", "n")


#: Keywords that are picked, and the reports that they are picked from by turns.
MOST_PICKED, SOURCES = 30, ("quick-wins", "second-page", "striking-distance")


def opportunity_sources(rows: DataFrame) -> DataFrame:
    """query, page, source, source_order, metric of the reports that keywords are picked from."""
    part = lambda df, name, order, metric: df.select("query", "page", F.lit(name).alias("source"), F.lit(order).alias("source_order"), F.col(metric).cast("double").alias("metric"))
    second = rows.filter(valid_search_row() & (F.col("position") > 10) & (F.col("position") <= 20))
    return part(quick_win_rows(rows), "quick-wins", 1, "shortfall").union(part(second, "second-page", 2, "impressions")).union(part(striking_distance_rows(rows), "striking-distance", 3, "score"))


@report(
    "keyword_opportunities",
    f"""WITH {_QUICK}, {_STRIKING[_STRIKING.index('striking AS'):]}, src AS (SELECT query, page, 'quick-wins' AS source, 1 AS source_order, shortfall AS metric FROM quick
   UNION ALL SELECT query, page, 'second-page', 2, impressions FROM query_page WHERE position > 10 AND position <= 20 UNION ALL SELECT query, page, 'striking-distance', 3, score FROM scored),
  best AS (SELECT query, source, source_order, max(metric) AS metric FROM src GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY metric DESC, query) AS r FROM best),
  picked AS (SELECT query, min_by(source, struct_pack(a := r, b := source_order)) AS source, min(r * 10 + source_order) AS turn FROM ranked GROUP BY query)
  SELECT query, source, turn FROM picked ORDER BY turn, query LIMIT 30""",
)
def keyword_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords picked from three reports by turns."""
    best = opportunity_sources(query_page_table(spark, sf_dir)).groupBy("query", "source", "source_order").agg(F.max("metric").alias("metric"))
    # the first MOST_PICKED of a source suffice: one source alone gives so many keywords before the next of its own
    first = [best.filter(F.col("source") == s).orderBy(F.desc("metric"), "query").limit(MOST_PICKED) for s in SOURCES]
    ranked = reduce(DataFrame.union, first).withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("metric"), "query")))
    picked = ranked.groupBy("query").agg(F.min_by("source", F.struct("r", "source_order")).alias("source"), F.min(F.col("r") * 10 + F.col("source_order")).alias("turn"))
    return picked.orderBy("turn", "query").limit(MOST_PICKED)


@report(
    "query_normaliser",
    "SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS query, count(*) AS n FROM part GROUP BY 1",
)
def query_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(normal_query(F.col("p_name")).alias("query")).agg(F.count("*").alias("n"))


@report(
    "expected_clicks",
    f"WITH {QUERY_PAGE} SELECT query, floor(sum(floor([0.27, 0.15, 0.10, 0.07, 0.05, 0.035, 0.025, 0.02, 0.015, 0.012][greatest(1, least(10, floor(position + 0.5)))::INT]::DOUBLE * 1000 + 0.5) * impressions) + 0.5) / 1000 AS expected FROM query_page GROUP BY query",
)
def expected_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that the common curve gives the positions of a query."""
    return query_page(spark, sf_dir).groupBy("query").agg((F.sum(F.floor(curve_ctr(F.col("position")) * 1000 + 0.5) * F.col("impressions")) / 1000).alias("expected"))
