"""Keyword sets, intents, links and composite reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_text
from ..operators.intervals import meeting_totals
from ..operators.ranks import ranked, running
from ..operators.tables import shared_dir, written
from ..sources.stores import SnapshotStore
from ..sources.views import ACCESS_LOG, QUERY_PAGE, RANKED, SEARCH_ROWS, query_page, query_page_table, ranked_keywords, search_rows, table
from .log_reports import crawler_paths
from .search_reports import _DECAY, _QUICK, _STRIKING, _WINDOWS_OF, decay_rows, quick_win_rows, striking_distance_rows, supplier_windows, windows

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_ASKED = """asked AS (SELECT p_partkey AS id, concat(CASE p_partkey % 8 WHEN 0 THEN 'how to fix ' WHEN 1 THEN 'best ' WHEN 2 THEN 'what is a ' ELSE '' END, p_name,
  CASE p_partkey % 8 WHEN 3 THEN ' vs bolt' WHEN 4 THEN ' reviews' WHEN 5 THEN ' reddit' WHEN 6 THEN ' in paris' WHEN 7 THEN ' near me' ELSE '' END) AS query FROM part)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of several intents: id, query."""
    k = F.col("p_partkey") % 8
    before = F.when(k == 0, "how to fix ").when(k == 1, "best ").when(k == 2, "what is a ").otherwise("")
    after = F.when(k == 3, " vs bolt").when(k == 4, " reviews").when(k == 5, " reddit").when(k == 6, " in paris").when(k == 7, " near me").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(before, "p_name", after).alias("query"))


#: Intents that communities answer, in the order in which they are looked for, by words and phrases.
COMMUNITY = [
    ("forum/reddit", ["reddit", "forum", "forums"]),
    ("comparison", ["alternative to", "alternatives to"]),
    ("reviews", ["review", "reviews", "complaint", "complaints", "worth it"]),
    ("experience", ["first hand", "firsthand", "my experience", "experience with", "people say", "real user", "real users", "user opinion", "user opinions"]),
    ("recommendation", ["best", "recommend", "recommended", "recommendation", "recommendations", "recommending"]),
]
#: Forms that tell an intent too, of the words between single spaces: things on both sides of "vs", an ending, a ranked list.
COMMUNITY_FORMS = {"comparison": "[^ ] (vs|versus) [^ ]|alternatives? $", "recommendation": " top [0-9]+ "}


def community_intent_of(query: Column) -> tuple[Column, Column]:
    """(first intent, all signals) of a query."""
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(normal_text(query), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), " "), F.lit(" "))

    def signals_of(padded: Column) -> Column:
        def told(intent: str, phrases: list[str]) -> Column:
            found = reduce(lambda a, b: a | b, [padded.contains(f" {p} ") for p in phrases])
            return found | padded.rlike(COMMUNITY_FORMS[intent]) if intent in COMMUNITY_FORMS else found

        return F.array_compact(F.array(*[F.when(told(*c), F.lit(c[0])) for c in COMMUNITY]))

    signals = F.element_at(F.transform(F.array(words), signals_of), 1)
    return F.get(signals, F.lit(0)), signals


_COMMUNITY_SQL = ", ".join(
    "CASE WHEN " + " OR ".join([f"contains(p, ' {x} ')" for x in phrases] + ([f"regexp_matches(p, '{COMMUNITY_FORMS[n]}')"] if n in COMMUNITY_FORMS else [])) + f" THEN '{n}' END" for n, phrases in COMMUNITY
)


@report(
    "community_intent",
    f"""WITH {_ASKED}, w AS (SELECT id, concat(' ', array_to_string(regexp_extract_all(lower(query), '[a-z0-9'']+'), ' '), ' ') AS p FROM asked), s AS (SELECT id, list_filter([{_COMMUNITY_SQL}], lambda x: x IS NOT NULL) AS signals FROM w)
    SELECT signals[1] AS intent, count(*) AS n, sum(len(signals))::BIGINT AS n_signals FROM s WHERE len(signals) > 0 GROUP BY 1""",
)
def community_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent, signals = community_intent_of(F.col("query"))
    rows = asked(spark, sf_dir).select(intent.alias("intent"), F.size(signals).alias("n_signals")).filter("intent IS NOT NULL")
    return rows.groupBy("intent").agg(F.count("*").alias("n"), F.sum("n_signals").alias("n_signals"))


PLACES = ["paris", "berlin", "new york"]


@report(
    "local_search_demand",
    f"""WITH {_ASKED}, l AS (SELECT query, CASE WHEN regexp_matches(query, '\\bnear me\\b') THEN 'nearby' WHEN regexp_matches(query, '\\bparis\\b') THEN 'paris' WHEN regexp_matches(query, '\\bberlin\\b') THEN 'berlin' WHEN regexp_matches(query, '\\bnew york\\b') THEN 'new york' END AS place FROM asked)
    SELECT query, place, count(*) AS n FROM l WHERE place IS NOT NULL GROUP BY 1, 2""",
)
def local_search_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a place of a dictionary, or that ask for what is near."""
    q = F.col("query")
    place = reduce(lambda rest, p: F.when(q.rlike(rf"\b{p}\b"), p).otherwise(rest), reversed(PLACES), F.lit(None).cast("string"))
    rows = asked(spark, sf_dir).select("query", F.when(q.rlike(r"\bnear me\b"), "nearby").otherwise(place).alias("place")).filter("place IS NOT NULL")
    return rows.groupBy("query", "place").agg(F.count("*").alias("n"))


@report(
    "seo_to_ai_query",
    f"""WITH {_ASKED}, p AS (SELECT id, query, trim(regexp_replace(regexp_replace(query, '^(how to|what is a|best) ', ''), ' (reviews|reddit)$', '')) AS subject FROM asked),
    a AS (SELECT id, list_filter([CASE WHEN regexp_matches(query, '^(how|what)') THEN concat(query, '?') END, concat('What should someone know about ', subject, '?'), CASE WHEN regexp_matches(query, '\\bbest\\b') THEN concat('Which ', subject, ' options fit which needs?') END, CASE WHEN regexp_matches(query, ' vs ') THEN concat('How do ', replace(subject, ' vs ', ' and '), ' differ?') END], lambda x: x IS NOT NULL) AS prompts FROM p)
    SELECT id, i - 1 AS place, prompts[i] AS prompt FROM (SELECT id, prompts, unnest(range(1, len(prompts) + 1)) AS i FROM a)""",
)
def seo_to_ai_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that a query stands for, five at most."""
    q = F.col("query")
    subject = F.trim(F.regexp_replace(F.regexp_replace(q, "^(how to|what is a|best) ", ""), " (reviews|reddit)$", ""))
    prompts = F.array_compact(
        F.array(
            F.when(q.rlike("^(how|what)"), F.concat(q, F.lit("?"))), F.concat(F.lit("What should someone know about "), subject, F.lit("?")),
            F.when(q.rlike(r"\bbest\b"), F.concat(F.lit("Which "), subject, F.lit(" options fit which needs?"))), F.when(q.rlike(" vs "), F.concat(F.lit("How do "), F.replace(subject, F.lit(" vs "), F.lit(" and ")), F.lit(" differ?"))),
        )
    )
    return asked(spark, sf_dir).select("id", F.posexplode(F.slice(F.array_distinct(prompts), 1, 5)).alias("place", "prompt"))


@report(
    "content_coverage",
    f"""WITH {_ASKED}, t AS (SELECT a.id, list_distinct(string_split(a.query, ' ')) AS terms, string_split(concat(p_name, ' ', lower(p_type)), ' ') AS words FROM asked a JOIN part ON p_partkey = a.id),
    c AS (SELECT id, len(list_filter(terms, lambda x: list_contains(words, x)))::DOUBLE / len(terms) AS coverage FROM t) SELECT id, coverage, CASE WHEN coverage >= 0.8 THEN 'covered' WHEN coverage > 0 THEN 'partial' ELSE 'missing' END AS class FROM c""",
)
def content_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a query's words that a page's fields have."""
    fields = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ").alias("words"))
    terms = F.array_distinct(F.split("query", " "))
    share = F.size(F.array_intersect(terms, F.col("words"))) / F.size(terms)
    rows = asked(spark, sf_dir).join(fields, "id").select("id", share.alias("coverage"))
    return rows.withColumn("class", F.when(F.col("coverage") >= 0.8, "covered").when(F.col("coverage") > 0, "partial").otherwise("missing"))


@report(
    "saved_keywords",
    f"""WITH {_ASKED}, tags AS (SELECT id, 'size' AS tag FROM asked WHERE query LIKE '%small%' UNION ALL SELECT id, 'review' FROM asked WHERE query LIKE '%reviews%')
    SELECT id, query, (SELECT list_sort(list(tag)) FROM tags t WHERE t.id = asked.id) AS tags FROM asked WHERE id IN (SELECT id FROM tags WHERE tag = 'size') ORDER BY query, id LIMIT 50 OFFSET 10""",
)
def saved_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the keywords with a tag, with all their tags beside them."""
    items = asked(spark, sf_dir)
    tag = lambda like, name: items.filter(F.col("query").contains(like)).select("id", F.lit(name).alias("tag"))
    tags = tag("small", "size").union(tag("reviews", "review"))
    listed = tags.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return items.join(tags.filter("tag = 'size'"), "id", "left_semi").join(listed, "id", "left").orderBy("query", "id").offset(10).limit(50)


@report(
    "keyword_set_upsert",
    f"""WITH {_ASKED}, old AS (SELECT id, query FROM asked WHERE id % 3 <> 0), new AS (SELECT id, concat(query, ' new') AS query FROM asked WHERE id % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.query, o.query) AS query FROM old o FULL OUTER JOIN new n ON n.id = o.id WHERE coalesce(n.id, o.id) % 5 <> 0""",
)
def keyword_set_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or replace by key, then delete by key, as runs of a store that is read afterwards; the first run is written twice."""
    items = asked(spark, sf_dir).select("id", "query")
    store = SnapshotStore(spark, f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}", "id long, query string", ["id"])
    for _ in range(2):
        store.append("1", items.filter("id % 3 <> 0"))
    store.append("2", items.filter("id % 2 = 0").withColumn("query", F.concat("query", F.lit(" new"))))
    store.delete("3", items.filter("id % 5 = 0"))
    return store.latest()


@report(
    "spend_totals",
    "SELECT o_orderstatus AS state, sum(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 10 END, o_orderkey * 12))::BIGINT AS micros, bool_and(o_orderkey % 3 <> 0) AS all_known, CASE WHEN bool_and(o_orderkey % 3 <> 0) THEN sum(o_orderkey * 10)::DOUBLE END AS known_micros FROM orders GROUP BY 1",
)
def spend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual costs where they are known, else estimates; the known sum only if all are known."""
    actual = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 10)
    known = F.bool_and(actual.isNotNull())
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.sum(F.coalesce(actual, F.col("o_orderkey") * 12)).alias("micros"), known.alias("all_known"), F.when(known, F.sum(actual).cast("double")).alias("known_micros"))


@report(
    "fanout_themes",
    "WITH t AS (SELECT l_orderkey AS observation, unnest(string_split(p_name, ' ')) AS term FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT term, count(DISTINCT observation) AS n FROM t GROUP BY term HAVING count(DISTINCT observation) >= 2",
)
def fanout_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that two observations or more have."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    terms = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.explode(F.split("p_name", " ")).alias("term"))
    return terms.groupBy("term").agg(F.countDistinct("l_orderkey").alias("n")).filter("n >= 2")


@report(
    "citation_changes",
    """WITH d AS (SELECT o_custkey % 100 AS prompt, CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 'before' ELSE 'after' END AS side, concat('site-', o_orderkey % 9, '.example') AS domain FROM orders),
    g AS (SELECT prompt, list(DISTINCT domain) FILTER (WHERE side = 'before') AS b, list(DISTINCT domain) FILTER (WHERE side = 'after') AS a FROM d GROUP BY prompt)
    SELECT prompt, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS added, list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS removed FROM g""",
)
def citation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that the answers to a prompt began and ceased to cite."""
    early = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp")
    domain = F.concat(F.lit("site-"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".example"))
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("prompt")).agg(F.collect_set(F.when(early, domain)).alias("b"), F.collect_set(F.when(~early, domain)).alias("a"))
    return g.select("prompt", F.array_sort(F.array_except("a", "b")).alias("added"), F.array_sort(F.array_except("b", "a")).alias("removed"))


_EVIDENCE = f"""{SEARCH_ROWS}, found AS (SELECT concat('https://shop.example/', lower(p_type), '/supplier-', CAST(p_partkey % 14 AS VARCHAR)) AS target, concat('https://ref-', p_partkey % 30, '.example/') AS source FROM part),
  t AS (SELECT target, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM found GROUP BY target), s AS (SELECT page, sum(clicks)::BIGINT AS clicks FROM search_rows GROUP BY page),
  k AS (SELECT DISTINCT page FROM search_rows WHERE page NOT LIKE '%supplier-7')"""


@report(
    "link_evidence",
    f"""WITH {_EVIDENCE} SELECT target, n_links, n_sources, CASE WHEN k.page IS NOT NULL THEN 'observed' ELSE 'missing' END AS crawl_state, s.clicks::DOUBLE AS clicks, CASE WHEN k.page IS NULL AND s.page IS NOT NULL THEN 'linked-not-crawled' WHEN k.page IS NULL THEN 'unknown-target' WHEN coalesce(s.clicks, 0) > 0 THEN 'linked-and-visited' ELSE 'linked-not-visited' END AS finding
    FROM t LEFT JOIN k ON k.page = target LEFT JOIN s ON s.page = target""",
)
def link_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with what the crawl and the search rows know of them; what isn't known stays null."""
    p = table(spark, sf_dir, "part")
    found = p.select(F.concat(F.lit("https://shop.example/"), F.lower("p_type"), F.lit("/supplier-"), (F.col("p_partkey") % 14).cast("string")).alias("target"), (F.col("p_partkey") % 30).alias("source"))
    t = found.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("source").alias("n_sources"))
    s = search_rows(spark, sf_dir).groupBy(F.col("page").alias("target")).agg(F.sum("clicks").alias("clicks"))
    k = search_rows(spark, sf_dir).filter(~F.col("page").endswith("supplier-7")).select(F.col("page").alias("target")).distinct().withColumn("crawled", F.lit(True))
    rows = t.join(k, "target", "left").join(s.withColumn("searched", F.lit(True)), "target", "left")
    missing = F.col("crawled").isNull()
    finding = F.when(missing & F.col("searched").isNotNull(), "linked-not-crawled").when(missing, "unknown-target").when(F.coalesce("clicks", F.lit(0)) > 0, "linked-and-visited").otherwise("linked-not-visited")
    return rows.select("target", "n_links", "n_sources", F.when(missing, "missing").otherwise("observed").alias("crawl_state"), F.col("clicks").cast("double").alias("clicks"), finding.alias("finding"))


@report(
    "change_confounders",
    f"""WITH {_WINDOWS_OF}, c AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT name, count(id) AS n_changes FROM w LEFT JOIN c ON day BETWEEN a AND b GROUP BY name""",
)
def change_confounders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged changes, the urgent orders, that fall into the windows of each supplier; windows without one have 0."""
    day, known = F.to_date("o_orderdate"), F.col("o_orderkey").isNotNull().cast("long")
    c = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(known.alias("n_changes"), day.alias("begin"), day.alias("until"))
    c = c.filter("begin IS NOT NULL")
    return meeting_totals(supplier_windows(spark, sf_dir), c, F.current_date(), sums=("n_changes",)).groupBy("name").agg(F.sum("n_changes").alias("n_changes"))


@report(
    "import_combine",
    """WITH a AS (SELECT p_name AS keyword, p_size AS volume, 'a' AS file FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, p_size + 1, 'b' FROM part WHERE p_partkey % 3 = 0)
    SELECT keyword, count(*) AS n_rows, count(DISTINCT file) AS n_files, min(volume) AS volume FROM a GROUP BY keyword""",
)
def import_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several files; of those that share a key the smallest stays."""
    p = table(spark, sf_dir, "part")
    part = lambda k, more, name: p.filter(F.col("p_partkey") % k == 0).select(F.col("p_name").alias("keyword"), (F.col("p_size") + more).alias("volume"), F.lit(name).alias("file"))
    return part(2, 0, "a").unionByName(part(3, 1, "b")).groupBy("keyword").agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"), F.min("volume").alias("volume"))


@report(
    "import_numbers",
    r"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, 'K') WHEN 1 THEN concat('$', p_partkey, '.5') WHEN 2 THEN concat(p_partkey, '%') WHEN 3 THEN 'n/a' ELSE concat('1,', lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')) END AS raw FROM part),
    c AS (SELECT id, raw, try_cast(regexp_replace(raw, '[$,%KMB]', '', 'g') AS DOUBLE) * CASE right(raw, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END AS value FROM r)
    SELECT id, value, CASE WHEN value IS NULL THEN 'invalid' ELSE 'observed' END AS state FROM c""",
)
def import_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as exports write them; what can't be read is invalid, not zero."""
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit("K"))).when(k == 1, F.concat(F.lit("$"), n, F.lit(".5"))).when(k == 2, F.concat(n, F.lit("%"))).when(k == 3, "n/a").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
    unit = F.when(raw.endswith("K"), 1e3).when(raw.endswith("M"), 1e6).when(raw.endswith("B"), 1e9).otherwise(1.0)
    value = F.regexp_replace(raw, "[$,%KMB]", "").try_cast("double") * unit
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), value.alias("value")).withColumn("state", F.when(F.col("value").isNull(), "invalid").otherwise("observed"))


@report(
    "refresh_priorities",
    f"""WITH {_QUICK}, {_STRIKING[_STRIKING.index('striking AS'):]}, {_DECAY[_DECAY.index('prev AS'):]},
    drafts AS (SELECT 'quick-win' AS source, page, query, shortfall AS impact FROM quick UNION ALL SELECT 'striking', page, query, score FROM scored UNION ALL SELECT 'decay', page, query, loss * 20 FROM decay WHERE reason IS NULL),
    w AS (SELECT source, page, least(100, 12 * ln(1 + impact)) * CASE source WHEN 'decay' THEN 1.2 WHEN 'quick-win' THEN 1.1 ELSE 1.0 END AS score FROM drafts WHERE impact > 0),
    g AS (SELECT source, page, count(*) AS n, max(score) AS best FROM w GROUP BY 1, 2)
    SELECT source, page, n, floor(least(300, best * (1 + ln(n::DOUBLE) / 8)) * 100 + 0.5) / 100 AS score FROM g ORDER BY score DESC, source, page LIMIT 25""",
)
def refresh_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of three reports, weighed, grouped by target and ranked together."""
    rows = query_page_table(spark, sf_dir)
    part = lambda df, name, impact: df.select(F.lit(name).alias("source"), "page", F.col(impact).cast("double").alias("impact"))
    decay = decay_rows(*windows(spark, sf_dir, "query", "page")).filter("reason IS NULL").withColumn("impact", F.col("loss") * 20)
    drafts = part(quick_win_rows(rows), "quick-win", "shortfall").union(part(striking_distance_rows(rows), "striking", "score")).union(part(decay, "decay", "impact"))
    factor = F.when(F.col("source") == "decay", 1.2).when(F.col("source") == "quick-win", 1.1).otherwise(1.0)
    w = drafts.filter("impact > 0").withColumn("score", F.least(F.lit(100.0), 12 * F.log1p("impact")) * factor)
    g = w.groupBy("source", "page").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    score = F.least(F.lit(300.0), F.col("best") * (1 + F.log(F.col("n").cast("double")) / 8))
    return g.select("source", "page", "n", (F.floor(score * 100 + 0.5) / 100).alias("score")).orderBy(F.desc("score"), "source", "page").limit(25)


@report(
    "competitive_opportunities",
    f"""WITH {RANKED}, {SEARCH_ROWS}, rating AS (SELECT concat('supplier-', s_suppkey, '.example') AS domain, floor(s_acctbal / 100)::INT AS rating FROM supplier), own AS (SELECT query AS keyword, min(position) AS position FROM search_rows WHERE clicks > 2 AND position < 5 GROUP BY 1),
    k AS (SELECT keyword, count(*) FILTER (WHERE rating < 40) AS n_weak, count(*) AS n_sources, sum(volume)::BIGINT AS volume FROM ranked JOIN rating USING (domain) WHERE rank <= 10 GROUP BY keyword)
    SELECT row_number() OVER (ORDER BY (own.keyword IS NOT NULL) DESC, n_weak DESC, n_sources DESC, volume DESC, k.keyword) AS review_order, k.keyword, n_weak, n_sources, volume, own.position::DOUBLE AS position FROM k LEFT JOIN own ON own.keyword = k.keyword""",
)
def competitive_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by how weak the domains are that rank for them, those that one ranks for already first."""
    rating = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("rating"))
    own = search_rows(spark, sf_dir).filter("clicks > 2 AND position < 5").groupBy(F.col("query").alias("keyword")).agg(F.min("position").cast("double").alias("position"))
    k = ranked_keywords(spark, sf_dir).filter("rank <= 10").join(rating, "domain").groupBy("keyword").agg(F.count_if(F.col("rating") < 40).alias("n_weak"), F.count("*").alias("n_sources"), F.sum("volume").alias("volume"))
    rows = k.join(own, "keyword", "left")
    order = [F.desc(F.col("position").isNotNull()), F.desc("n_weak"), F.desc("n_sources"), F.desc("volume"), F.col("keyword")]
    return ranked(rows, [], order, "review_order").select("review_order", "keyword", "n_weak", "n_sources", "volume", "position")


@report(
    "performance_ratings",
    "WITH m AS (SELECT page_id, strlen(html) AS v FROM pages) SELECT CASE WHEN v <= 4000 THEN 'good' WHEN v <= 8000 THEN 'needs-work' ELSE 'poor' END AS rating, count(*) AS n FROM m GROUP BY 1",
)
def performance_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").groupBy(F.when(size <= 4000, "good").when(size <= 8000, "needs-work").otherwise("poor").alias("rating")).agg(F.count("*").alias("n"))


def dimension_filter(dimension: str, operator: str, value: str) -> Column:
    """One condition of a search request; conditions are joined by AND."""
    c = F.col(dimension)
    return {
        "equals": c == value, "notEquals": c != value, "contains": c.contains(value), "notContains": ~c.contains(value), "includingRegex": c.rlike(value), "excludingRegex": ~c.rlike(value),
    }[operator]


@report("dimension_filters", f"WITH {QUERY_PAGE} SELECT query, page, clicks FROM query_page WHERE contains(page, 'small') AND NOT contains(query, 'bolt') AND regexp_matches(query, '^(red|blue)') AND NOT regexp_matches(page, '[789]$') AND query <> 'red ring'")
def dimension_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [("page", "contains", "small"), ("query", "notContains", "bolt"), ("query", "includingRegex", "^(red|blue)"), ("page", "excludingRegex", "[789]$"), ("query", "notEquals", "red ring")]
    return query_page(spark, sf_dir).filter(reduce(lambda a, b: a & b, [dimension_filter(*c) for c in conditions])).select("query", "page", "clicks")


@report(
    "report_pivot",
    "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS sessions, coalesce(try_cast(CASE WHEN o_custkey % 7 = 0 THEN '(not set)' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT), 0) AS users FROM orders",
)
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and positional cells of text to named columns; cells that aren't numbers count as none."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(F.lit("status"), F.lit("sessions"), F.lit("users")).alias("headers"),
        F.array("o_orderstatus", F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 7 == 0, "(not set)").otherwise(F.col("o_custkey").cast("string"))).alias("cells"),
    )
    named = raw.select("id", F.map_from_arrays("headers", "cells").alias("m"))
    return named.select("id", F.col("m")["status"].alias("status"), F.col("m")["sessions"].alias("sessions"), F.coalesce(F.col("m")["users"].try_cast("bigint"), F.lit(0)).alias("users"))


#: Rows and bytes that a file of log totals may have.
MOST_CSV_ROWS, MOST_CSV_BYTES = 25_000, 8_000


@report(
    "log_csv_budget",
    f"""WITH {ACCESS_LOG}, g AS (SELECT family, path, count(*) AS requests FROM access_log WHERE family IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, strlen(concat(family, ',', path, ',', requests)) + 1 AS bytes FROM g),
    r AS (SELECT *, row_number() OVER o AS n, sum(bytes) OVER o AS used, count(*) OVER () AS total FROM t WINDOW o AS (ORDER BY requests DESC, family, path)), k AS (SELECT * FROM r WHERE n <= {MOST_CSV_ROWS} AND used <= {MOST_CSV_BYTES})
    SELECT family, path, requests, bytes, total - (SELECT count(*) FROM k) AS omitted FROM k""",
)
def log_csv_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the crawler totals that fit a file's budget of rows and bytes, and how many don't."""
    g = crawler_paths(spark, sf_dir).select("family", "path", "requests")
    line = F.concat_ws(",", "family", "path", F.col("requests").cast("string"))
    sized = written(g.withColumn("bytes", F.octet_length(line) + 1), "log-totals")
    first = running(sized, [], [F.desc("requests"), F.col("family"), F.col("path")], place="n", sums={"used": F.col("bytes")})
    kept = written(first.filter((F.col("n") <= MOST_CSV_ROWS) & (F.col("used") <= MOST_CSV_BYTES)).drop("n", "used"), "log-csv")
    return kept.withColumn("omitted", F.lit(sized.count() - kept.count()))
