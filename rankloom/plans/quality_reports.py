"""Reports on the data themselves: status, caps, conflicts, dates, tasks; and the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import graphemes
from ..functions.urls import http_url
from ..sources.views import QUERY_PAGE, RANKED, SEARCH_DAILY, SEARCH_ROWS, SNAPSHOTS, query_page, ranked_keywords, search_daily, search_rows, snapshots, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- status of what a report was given ---------------------------------------------------------------------------------------------------


def data_status(rows: Column, kept: Column) -> Column:
    """empty without rows, filtered where none is left, else available."""
    return F.when(rows == 0, "empty").when(kept == 0, "filtered").otherwise("available")


def capped(confidence: Column, partial: Column) -> Column:
    """High confidence becomes medium where the evidence is partial."""
    return F.when(partial & (confidence == "high"), "medium").otherwise(confidence)


MOST_ROWS = 25


@report(
    "report_status",
    f"""WITH {SEARCH_ROWS}, g AS (SELECT page, count(*) AS n_rows, count(*) FILTER (WHERE clicks >= 5) AS n_kept FROM search_rows GROUP BY page)
    SELECT page, n_rows, n_kept, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_kept = 0 THEN 'filtered' ELSE 'available' END AS status, n_rows >= {MOST_ROWS} AS capped,
      CASE WHEN n_rows >= {MOST_ROWS} AND n_kept >= 10 THEN 'medium' WHEN n_kept >= 10 THEN 'high' ELSE 'low' END AS confidence FROM g""",
)
def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: whether there are data, whether the row cap of a fetch was reached, and a confidence that a partial fetch caps."""
    g = search_rows(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n_rows"), F.count_if(F.col("clicks") >= 5).alias("n_kept"))
    full = F.col("n_rows") >= MOST_ROWS
    confidence = F.when(F.col("n_kept") >= 10, "high").otherwise("low")
    return g.select("page", "n_rows", "n_kept", data_status(F.col("n_rows"), F.col("n_kept")).alias("status"), full.alias("capped"), capped(confidence, full).alias("confidence"))


@report(
    "analytics_warnings",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS lost FROM events GROUP BY 1),
    w AS (SELECT date, unnest(list_filter([CASE WHEN n > 300 THEN 'sampled' END, CASE WHEN users < 100 THEN 'thresholded' END, CASE WHEN lost * 20 > n THEN 'data-loss' END], lambda x: x IS NOT NULL)) AS warning FROM d)
    SELECT warning, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day FROM w GROUP BY 1""",
)
def analytics_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against the figures of a day, by kind."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("lost"))
    kinds = F.array_compact(F.array(F.when(F.col("n") > 300, "sampled"), F.when(F.col("users") < 100, "thresholded"), F.when(F.col("lost") * 20 > F.col("n"), "data-loss")))
    return d.select("date", F.explode(kinds).alias("warning")).groupBy("warning").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def without_conflicts(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, values, n_rows, n_duplicate and n_conflicting: equal rows of a key are one; where they differ, values are null.

    Counts don't depend on the order of the rows: a conflict counts all rows of its key.
    """
    same = F.col("_low").eqNullSafe(F.col("_high"))
    g = rows.groupBy(key).agg(F.min(F.struct(*values)).alias("_low"), F.max(F.struct(*values)).alias("_high"), F.count("*").alias("n_rows"))
    kept = [F.when(same, F.col(f"_low.{v}")).alias(v) for v in values]
    return g.select(key, *kept, "n_rows", F.when(same, F.col("n_rows") - 1).otherwise(0).alias("n_duplicate"), F.when(same, 0).otherwise(F.col("n_rows")).alias("n_conflicting"))


@report(
    "conflicting_dates",
    """WITH g AS (SELECT o_orderdate AS date, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, count(*) AS n_rows FROM orders GROUP BY 1)
    SELECT CAST(date AS DATE) AS date, CASE WHEN lo = hi THEN lo END AS status, n_rows, CASE WHEN lo = hi THEN n_rows - 1 ELSE 0 END AS n_duplicate, CASE WHEN lo = hi THEN 0 ELSE n_rows END AS n_conflicting FROM g""",
)
def conflicting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose rows differ are dropped; equal ones count once."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"))
    return without_conflicts(rows, "date", ["status"])


def dedupe_pages(rows: DataFrame, dims: list[str], page: str) -> DataFrame:
    """Rows of pages that overlap: of those with the same dimensions, the one of the first page stays."""
    rest = [c for c in rows.columns if c not in dims]
    kept = rows.groupBy(*dims).agg(F.min_by(F.struct(*rest), F.struct(page, *[c for c in rest if c != page])).alias("_row"))
    return kept.select(*dims, "_row.*")


@report(
    "paged_rows",
    """WITH r AS (SELECT CAST(ts AS DATE) AS date, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY date, kind) - 1 AS i FROM r),
    p AS (SELECT date, kind, n, i // 20 AS page FROM o UNION ALL SELECT date, kind, n, i // 20 + 1 FROM o WHERE i % 20 >= 15) SELECT date, kind, n, min(page) AS page FROM p GROUP BY 1, 2, 3""",
)
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch in pages of twenty rows, each of which repeats the last five of the page before."""
    from ..operators.ranks import ranked

    r = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    o = ranked(r, [], [F.col("date"), F.col("kind")], "i").withColumn("i", F.col("i") - 1)
    page = F.floor(F.col("i") / 20)
    again = o.filter("i % 20 >= 15").select("date", "kind", "n", (page + 1).alias("page"))
    return dedupe_pages(o.select("date", "kind", "n", page.alias("page")).union(again), ["date", "kind"], "page").select("date", "kind", "n", "page")


@report(
    "section_bounds",
    f"WITH {QUERY_PAGE}, s AS (SELECT CASE WHEN position <= 3 THEN 'top' WHEN position <= 10 THEN 'first-page' WHEN position <= 20 THEN 'second-page' ELSE 'beyond' END AS section FROM query_page) SELECT section, count(*) AS n, least(count(*), 50) AS returned, count(*) - least(count(*), 50) AS omitted FROM s GROUP BY 1",
)
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each section has, shows and leaves out."""
    p = F.col("position")
    section = F.when(p <= 3, "top").when(p <= 10, "first-page").when(p <= 20, "second-page").otherwise("beyond")
    n = query_page(spark, sf_dir).groupBy(section.alias("section")).agg(F.count("*").alias("n")).withColumn("returned", F.least("n", F.lit(50)))
    return n.withColumn("omitted", F.col("n") - F.col("returned"))


# --- dates -------------------------------------------------------------------------------------------------------------------------------


def iso_date(text: Column) -> Column:
    """The day of a text yyyy-MM-dd, null if it is none."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def final_range(now: Column, days: int = 28, late: int = 3) -> tuple[Column, Column]:
    """(first, last) day of the final data: `late` days before today on the Pacific coast, where the data's days begin."""
    last = F.date_sub(F.to_date(F.from_utc_timestamp(now, "America/Los_Angeles")), late)
    return F.date_sub(last, days - 1), last


_DATED = "CASE WHEN o_orderkey % 7 = 1 THEN '2024-02-30' WHEN o_orderkey % 7 = 2 THEN '2024-1-05' WHEN o_orderkey % 7 = 3 THEN 'soon' ELSE {day} END"


@report(
    "date_checks",
    f"""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, {_DATED.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS text, strftime(o_orderdate, '%Y%m%d') AS packed FROM orders),
    p AS (SELECT *, CASE WHEN regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(text AS DATE) END AS parsed FROM d)
    SELECT id, parsed, date_diff('day', parsed, DATE '2001-12-31') + 1 AS n_days, parsed + 28 AS shifted, day = CAST(strptime(packed, '%Y%m%d') AS DATE) AS same FROM p""",
)
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days read from texts, days up to a fixed one, both included, the day four weeks later, and days of eight digits."""
    o = table(spark, sf_dir, "orders")
    text = F.expr(_DATED.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"))
    parsed = o.select(F.col("o_orderkey").alias("id"), iso_date(text).alias("parsed"), (F.to_date("o_orderdate") == F.to_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")).alias("same"))
    return parsed.select("id", "parsed", (F.datediff(F.lit("2001-12-31").cast("date"), "parsed") + 1).cast("long").alias("n_days"), F.date_add("parsed", 28).alias("shifted"), "same")


@report("final_ranges", "WITH t AS (SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) - 3 AS last FROM events) SELECT event_id, last - 27 AS first, last FROM t")
def final_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = final_range(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", first.alias("first"), last.alias("last"))


# --- tasks -------------------------------------------------------------------------------------------------------------------------------

#: The states of a task, by what happens to it; a reservation lapses after so many minutes.
TASK_STATES = {"view": "pending", "click": "posting", "signup": "posted", "purchase": "complete", "error": "failed"}
RESERVED_MINUTES = 15


@report(
    "task_states",
    f"""WITH now AS (SELECT max(ts) AS now FROM events), last AS (SELECT user_id AS task, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS kind, max(ts) AS since, count(*) AS n_events FROM events GROUP BY 1)
    SELECT task, n_events, CASE WHEN kind = 'click' AND date_diff('second', since, now) > {RESERVED_MINUTES * 60} THEN 'pending' ELSE CASE kind WHEN 'view' THEN 'pending' WHEN 'click' THEN 'posting' WHEN 'signup' THEN 'posted' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END END AS state FROM last, now""",
)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each task after its last event; one that was reserved too long ago is pending again."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]  # one value
    last = e.groupBy(F.col("user_id").alias("task")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("since"), F.count("*").alias("n_events"))
    lapsed = (F.col("kind") == "click") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("since") > RESERVED_MINUTES * 60)
    state = F.when(lapsed, "pending").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in TASK_STATES.items() for x in kv]), F.col("kind")))
    return last.select("task", "n_events", state.alias("state"))


# --- findings of changes -----------------------------------------------------------------------------------------------------------------


@report(
    "engine_findings",
    f"""WITH {SEARCH_DAILY}, m AS (SELECT max(date) AS d FROM search_daily),
    p AS (SELECT sum(clicks) FILTER (WHERE date > d - 14) AS c1, sum(clicks) FILTER (WHERE date <= d - 14 AND date > d - 28) AS c0, sum(impressions) FILTER (WHERE date > d - 14) AS i1, sum(impressions) FILTER (WHERE date <= d - 14 AND date > d - 28) AS i0,
      count(*) FILTER (WHERE date > d - 14) AS n1, count(*) FILTER (WHERE date <= d - 14 AND date > d - 28) AS n0 FROM search_daily, m),
    e AS (SELECT count(*) FILTER (WHERE CAST(ts AS DATE) > d - 14 AND event_type = 'error') AS e1, count(*) FILTER (WHERE CAST(ts AS DATE) <= d - 14 AND CAST(ts AS DATE) > d - 28 AND event_type = 'error') AS e0 FROM events, m),
    f AS (SELECT unnest(list_filter([CASE WHEN n1 = 14 AND n0 = 14 AND c0 > 0 AND abs(c1 - c0) * 100.0 / c0 >= 2 THEN CASE WHEN c1 < c0 THEN 'clicks_declined' ELSE 'clicks_increased' END END,
      CASE WHEN n1 = 14 AND n0 = 14 AND i0 > 0 AND abs(i1 - i0) * 100.0 / i0 >= 2 THEN CASE WHEN i1 < i0 THEN 'impressions_declined' ELSE 'impressions_increased' END END,
      CASE WHEN e1 - e0 >= greatest(10, ceil(0.5 * e0)) THEN 'errors_increased' END], lambda x: x IS NOT NULL)) AS code FROM p, e) SELECT code FROM f""",
)
def engine_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two whole fortnights: traffic by two in a hundred or more, errors by half of what they were and ten at least."""
    daily = search_daily(spark, sf_dir)
    end = daily.agg(F.max("date").alias("d")).first()["d"]  # one day
    days = F.datediff(F.lit(end), F.col("date"))
    now, before = days < 14, (days >= 14) & (days < 28)
    part = lambda c, when, name: F.sum(F.when(when, F.col(c))).alias(name)
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("errors"))
    both = daily.join(errors, "date", "left").fillna(0, ["errors"])
    p = both.agg(*[part(c, w, f"{c}_{n}") for c in ("clicks", "impressions", "errors") for n, w in (("now", now), ("before", before))], F.count_if(now).alias("n_now"), F.count_if(before).alias("n_before"))
    whole = (F.col("n_now") == 14) & (F.col("n_before") == 14)

    def moved(c: str) -> Column:
        a, b = F.col(f"{c}_now"), F.col(f"{c}_before")
        return F.when(whole & (b > 0) & (F.abs(a - b) * 100.0 / b >= 2), F.when(a < b, f"{c}_declined").otherwise(f"{c}_increased"))

    worse = F.when(F.col("errors_now") - F.col("errors_before") >= F.greatest(F.lit(10), F.ceil(0.5 * F.col("errors_before"))), "errors_increased")
    return p.select(F.explode(F.array_compact(F.array(moved("clicks"), moved("impressions"), worse))).alias("code"))


@report(
    "recovery_severity",
    f"""WITH {SEARCH_ROWS}, p AS (SELECT page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, length(page) % 5 AS k FROM search_rows GROUP BY page),
    i AS (SELECT *, CASE k WHEN 0 THEN 'final-4xx' WHEN 1 THEN 'redirect-loop' WHEN 2 THEN 'non-indexable-final' WHEN 3 THEN 'final-5xx' ELSE 'canonical-mismatch' END AS issue FROM p)
    SELECT page, issue, CASE WHEN issue IN ('final-5xx', 'final-4xx') THEN CASE WHEN clicks >= 10 OR impressions >= 500 THEN 'high' ELSE 'medium' END WHEN issue = 'redirect-loop' THEN 'high'
      WHEN issue = 'non-indexable-final' THEN CASE WHEN clicks >= 5 OR impressions >= 250 THEN 'high' ELSE 'medium' END WHEN clicks >= 10 OR impressions >= 500 THEN 'medium' ELSE 'low' END AS severity FROM i""",
)
def recovery_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a broken target matters, by what is wrong with it and what it brings."""
    p = search_rows(spark, sf_dir).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    k = F.length("page") % 5
    issue = F.when(k == 0, "final-4xx").when(k == 1, "redirect-loop").when(k == 2, "non-indexable-final").when(k == 3, "final-5xx").otherwise("canonical-mismatch")
    seen = lambda clicks, impressions: (F.col("clicks") >= clicks) | (F.col("impressions") >= impressions)
    either = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    severity = F.when(F.col("issue").isin("final-5xx", "final-4xx"), either(seen(10, 500), "high", "medium")).when(F.col("issue") == "redirect-loop", "high")
    severity = severity.when(F.col("issue") == "non-indexable-final", either(seen(5, 250), "high", "medium")).otherwise(either(seen(10, 500), "medium", "low"))
    return p.withColumn("issue", issue).select("page", "issue", severity.alias("severity"))


# --- joins of sources --------------------------------------------------------------------------------------------------------------------


@report(
    "property_demand",
    f"WITH {QUERY_PAGE}, p AS (SELECT query, sum(impressions)::BIGINT AS seen FROM query_page GROUP BY 1), t AS (SELECT p_name AS query, sum(p_size)::BIGINT * 1000 AS total FROM part WHERE p_size > 25 GROUP BY 1) SELECT p.query, coalesce(total, seen) AS demand, total IS NOT NULL AS from_property FROM p LEFT JOIN t ON t.query = p.query",
)
def property_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of a query from the totals of the whole property, else the sum over its pages."""
    seen = query_page(spark, sf_dir).groupBy("query").agg(F.sum("impressions").alias("seen"))
    totals = table(spark, sf_dir, "part").filter("p_size > 25").groupBy(F.col("p_name").alias("query")).agg((F.sum(F.col("p_size").cast("long")) * 1000).alias("total"))
    return seen.join(totals, "query", "left").select("query", F.coalesce("total", "seen").alias("demand"), F.col("total").isNotNull().alias("from_property"))


@report(
    "page_analytics",
    r"""WITH k AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages), a AS (SELECT path, sum(page_id % 50)::BIGINT AS sessions FROM k WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, path, sessions FROM k LEFT JOIN a USING (path)""",
)
def page_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the pages by their path, without query and trailing slash; null where analytics have none."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    k = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    a = k.filter("page_id % 3 = 0").groupBy("path").agg(F.sum(F.col("page_id") % 50).alias("sessions"))
    return k.join(a, "path", "left").select("page_id", "path", "sessions")


@report(
    "export_reconcile",
    r"""WITH k AS (SELECT DISTINCT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages), e AS (SELECT DISTINCT path FROM k WHERE page_id % 4 <> 0), c AS (SELECT DISTINCT path FROM k WHERE page_id % 3 <> 0)
    SELECT CASE WHEN c.path IS NULL THEN 'export-only' WHEN e.path IS NULL THEN 'crawl-only' ELSE 'matched' END AS class, count(*) AS n FROM e FULL JOIN c ON c.path = e.path GROUP BY 1""",
)
def export_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an export and of a crawl: in both, or in one alone. One aggregation of flags."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    flags = table(spark, sf_dir, "pages").groupBy(path.alias("path")).agg(F.max((F.col("page_id") % 4 != 0).cast("int")).alias("e"), F.max((F.col("page_id") % 3 != 0).cast("int")).alias("c")).filter("e + c > 0")
    return flags.groupBy(F.when(F.col("c") == 0, "export-only").when(F.col("e") == 0, "crawl-only").otherwise("matched").alias("class")).agg(F.count("*").alias("n"))


@report(
    "imported_cannibalisation",
    """WITH r AS (SELECT lower(concat(p_name, ' ', p_type)) AS keyword, concat('/s/', l_suppkey % 10) AS url, min(1 + (l_partkey * 5 + l_suppkey * 3 + l_linenumber) % 100) AS best, max(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT keyword, count(*) AS n_urls, min(best) AS best_position, min_by(url, struct_pack(b := best, u := url)) AS best_url, max(volume) AS volume FROM r GROUP BY 1 HAVING count(*) >= 2""",
)
def imported_cannibalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported keywords that several urls rank for: the best position of each url, the largest volume that was observed."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.select(
        F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("keyword"), F.concat(F.lit("/s/"), (F.col("l_suppkey") % 10).cast("string")).alias("url"),
        (1 + (F.col("l_partkey") * 5 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 100).alias("position"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("long")).alias("volume"),
    )
    urls = rows.groupBy("keyword", "url").agg(F.min("position").alias("best"), F.max("volume").alias("volume"))
    g = urls.groupBy("keyword").agg(F.count("*").alias("n_urls"), F.min("best").alias("best_position"), F.min_by("url", F.struct("best", "url")).alias("best_url"), F.max("volume").alias("volume"))
    return g.filter("n_urls >= 2")


@report(
    "local_competitors",
    f"""WITH {RANKED}, t AS (SELECT * FROM ranked WHERE rank <= 10), n AS (SELECT count(DISTINCT keyword) AS n FROM t)
    SELECT domain, count(*) AS appearances, count(DISTINCT keyword) AS n_queries, floor(count(DISTINCT keyword) * 1000.0 / any_value(n) + 0.5) / 10 AS coverage, min(rank) AS best_rank, min_by(keyword, struct_pack(r := rank, k := keyword)) AS representative FROM t, n GROUP BY domain""",
)
def local_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the first results of many queries: how often, for how many, how high, and the query where they stand best."""
    t = ranked_keywords(spark, sf_dir).filter("rank <= 10")
    n = t.agg(F.countDistinct("keyword").alias("n")).first()["n"]  # one number
    g = t.groupBy("domain").agg(F.count("*").alias("appearances"), F.countDistinct("keyword").alias("n_queries"), F.min("rank").alias("best_rank"), F.min_by("keyword", F.struct("rank", "keyword")).alias("representative"))
    return g.withColumn("coverage", F.floor(F.col("n_queries") * 1000.0 / n + 0.5) / 10)


@report(
    "stream_matches",
    r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages), p(property, kind, name) AS (VALUES ('sc-domain:example.com', 'domain', 'example.com'), ('sc-domain:example.org', 'domain', 'example.org'), ('https://therha.example.com/', 'host', 'therha.example.com'))
    SELECT host, property, CASE WHEN host = name THEN 'exact' ELSE 'subdomain' END AS match FROM h JOIN p ON host = name OR (kind = 'domain' AND ends_with(host, concat('.', name)))""",
)
def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of streams with the properties that they belong to: equal hosts, or hosts below a domain. Every host meets its own suffixes only."""
    properties = spark.createDataFrame([("sc-domain:example.com", "domain", "example.com"), ("sc-domain:example.org", "domain", "example.org"), ("https://therha.example.com/", "host", "therha.example.com")], "property string, kind string, name string")
    h = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)).alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = h.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("name"))
    rows = suffixes.join(properties, "name").filter((F.col("host") == F.col("name")) | (F.col("kind") == "domain"))
    return rows.select("host", "property", F.when(F.col("host") == F.col("name"), "exact").otherwise("subdomain").alias("match"))


@report(
    "brand_terms",
    f"""WITH {QUERY_PAGE}, q AS (SELECT query, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr, sum(position * impressions) / sum(impressions) AS position FROM query_page GROUP BY 1),
    e AS (SELECT *, clicks * 2 + impressions * ctr + greatest(0, 12 - position) * 10 AS score FROM q WHERE position <= 11 AND ctr >= 0.05), t AS (SELECT unnest(list_distinct(string_split(query, ' '))) AS term, query, score FROM e)
    SELECT term, floor(sum(score) * 100 + 0.5) / 100 AS score, count(*) AS n_queries, list(query ORDER BY score DESC, query)[1:3] AS evidence FROM t GROUP BY 1""",
)
def brand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the queries that rank high and are clicked often, by the sum of their scores, with the three best queries of each."""
    q = query_page(spark, sf_dir).groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), (F.sum("clicks").cast("double") / F.sum("impressions")).alias("ctr"), (F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions")).alias("position"))
    score = F.col("clicks") * 2 + F.col("impressions") * F.col("ctr") + F.greatest(F.lit(0.0), 12 - F.col("position")) * 10
    t = q.filter("position <= 11 AND ctr >= 0.05").select("query", score.alias("score"), F.explode(F.array_distinct(F.split("query", " "))).alias("term"))
    total = t.groupBy("term").agg((F.floor(F.sum("score") * 100 + 0.5) / 100).alias("score"), F.count("*").alias("n_queries"))
    best = t.withColumn("n", F.row_number().over(W.partitionBy("term").orderBy(F.desc("score"), "query"))).filter("n <= 3")
    evidence = best.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "query"))), lambda x: x["query"]).alias("evidence"))
    return total.join(evidence, "term")


# --- text functions over whole tables ----------------------------------------------------------------------------------------------------


@report("folded_texts", r"SELECT doc_id, sha256(trim(regexp_replace(lower(translate(strip_accents(coalesce(text, '')), '‘’', '''''')), '\s+', ' ', 'g'))) AS digest FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without diacritics, in lower case, by their digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normal_text(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@report(
    "word_counts",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1, '東京 tower とパリ no 1' UNION ALL SELECT -2, '한국 abc漢')
    SELECT doc_id, len(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+')) AS n_words FROM t""",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts in all scripts."""
    more = spark.createDataFrame([(-1, "東京 tower とパリ no 1"), (-2, "한국 abc漢")], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(more)
    return docs.select("doc_id", T.cjk_words(F.col("text")).alias("n_words"))


@report("name_hashes", "SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM part")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.fnv1a(F.col("p_name")).alias("hash"))


#: URLs written in other ways, and null for those that aren't http(s): for each remainder of a page's number its form in SQL.
_WRITTEN = [
    "upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)", "regexp_replace(url, '^(https://[^/?#]*)', '{1}:443')", "concat(url, CASE WHEN contains(url, '#') THEN '' ELSE '#top' END, '&token=abc123')", "concat('ftp', url)",
    "regexp_replace(url, '^(https?://)([^/?#]*)/', '{1}user:pass@{2}/x/%2E%2e/./y/../')", "replace(url, '://', ':')", "concat('  ', url, chr(10))", "regexp_replace(url, '^(https?)://([^/?#]*)/([a-z]*)/', '{1}:{b}{b}{2}{b}{3}{b}')", "regexp_replace(url, '^(https?://)([^/?#]*)', '{1}0x7f.1')", "regexp_replace(url, '^(https?://)([^/?#]*)', '{1}bücher.{2}')", "replace(url, '.example', '.exa mple')",
]
_WRITTEN_DUCK = "CASE page_id % 11 " + " ".join(f"WHEN {i} THEN {w.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2').replace('{3}', chr(92) + '3').replace('{b}', chr(92) * 2)}" for i, w in enumerate(_WRITTEN)) + " END"
_WRITTEN_SPARK = "CASE page_id % 11 " + " ".join(f"WHEN {i} THEN {w.replace('{1}', '$1').replace('{2}', '$2').replace('{3}', '$3').replace('{b}', chr(92) * 4)}" for i, w in enumerate(_WRITTEN)) + " END"


@report(
    "normal_urls",
    rf"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS plain, {_WRITTEN_DUCK} AS u FROM pages)
    SELECT page_id, CASE page_id % 11 WHEN 3 THEN NULL WHEN 10 THEN NULL WHEN 8 THEN regexp_replace(plain, '^(https?://)([^/?#]*)', '\1127.0.0.1') WHEN 9 THEN regexp_replace(plain, '^(https?://)([^/?#]*)', '\1xn--bcher-kva.\2') ELSE plain END AS url,
      regexp_replace(u, '(?i)(token=)[^&#\s]*', '\1[redacted]', 'g') AS shown FROM u""",
)
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs brought to one form, null for other schemes; and with the values of sensitive parameters taken out."""
    changed = F.expr(_WRITTEN_SPARK)
    return table(spark, sf_dir, "pages").select("page_id", http_url(changed).alias("url"), T.redact(changed).alias("shown"))


#: Characters of several code points, and how wide they are together: a family, two flags, a keycap, Hangul as letters, Latin with marks.
_SEEN = [("👨‍👩‍👧", 23.0, 1), ("🇩🇪🇫🇷", 46.0, 2), ("1️⃣", 23.0, 1), ("\u1112\u1161\u11ab", 20.0, 1), ("e\u0301\u0323", 11.1, 1), ("漢字", 40.0, 2), ("\u0627\u0644", 22.2, 2)]


@report(
    "title_characters",
    "WITH x(k, t, w, n) AS (VALUES " + ", ".join(f"({k}, '{t}', {w}::DOUBLE, {n})" for k, (t, w, n) in enumerate(_SEEN)) + """)
    SELECT page_id, length_grapheme(concat(url, ' ', t)) AS n_seen, w + 5.6 AS added, CASE WHEN k = 4 THEN 'high' WHEN k = 6 THEN 'low' ELSE 'medium' END AS confidence FROM pages JOIN x ON page_id % 7 = k""",
)
def title_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What characters of several code points add to the width of a title, and how sure the estimate is."""
    more = F.element_at(F.array(*[F.lit(t) for t, _, _ in _SEEN]), (F.col("page_id") % 7 + 1).cast("int"))
    with_more = F.concat("url", F.lit(" "), more)
    added = F.floor((T.title_pixels(with_more) - T.title_pixels(F.col("url"))) * 10 + 0.5) / 10
    return table(spark, sf_dir, "pages").select("page_id", F.size(graphemes(with_more)).cast("long").alias("n_seen"), added.alias("added"), T.title_confidence(with_more).alias("confidence"))


@report(
    "listed_intents",
    """WITH i AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Commercial, informational' WHEN 1 THEN 'transactional;unknown' WHEN 2 THEN 'navigational | Commercial' WHEN 3 THEN '' ELSE 'informational' END AS t FROM orders),
    g AS (SELECT id, list_transform(regexp_split_to_array(lower(t), '[,;|]'), lambda x: trim(x)) AS g FROM i) SELECT id, array_to_string(list_filter(['informational', 'navigational', 'commercial', 'transactional'], lambda x: list_contains(g, x)), ',') AS intents FROM g""",
)
def listed_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    given = F.when(k == 0, "Commercial, informational").when(k == 1, "transactional;unknown").when(k == 2, "navigational | Commercial").when(k == 3, "").otherwise("informational")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.ordered_intents(given).alias("intents"))


@report(
    "first_failures",
    f"WITH {SNAPSHOTS} SELECT url, count(*) AS n, count(*) FILTER (WHERE verdict IS NULL) AS n_failed, min(CASE WHEN verdict IS NULL THEN inspected_at END) AS first_failed FROM snapshots GROUP BY url",
)
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections of each url, those that failed, and when the first did."""
    failed = F.col("verdict").isNull()
    return snapshots(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("inspected_at"))).alias("first_failed"))
