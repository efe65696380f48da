"""Page patterns: templates with their metrics and verdicts, kinds and terms of queries, coverage, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured
from ..functions import text as T
from ..functions.columns import path_parts, url_signature
from ..functions.html import extracted
from ..operators.benchmark import leave_group_out
from ..sources.views import QUERY_PAGE, SEARCH_ROWS, query_page, query_page_table, search_rows, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- queries of all kinds ----------------------------------------------------------------------------------------------------------------

_AFFIXES = [
    ("", " vs bolts"), ("", " alternatives"), ("convert ", " to kg"), ("", " templates"), ("examples of ", ""), ("", " integrations"), ("", " calculator"), ("what is a ", ""), ("best ", ""), ("top 10 ", ""), ("", " without login"), ("download ", ""),
    ("", " meaning"), ("rare ", ""), ("how many ", ""), ("", " starting with b"), ("", " price"), ("", " reddit"), ("how to use ", "'s guide"), ("", ""), ("kg to ", ""), ("", " & rings"),
]
_ASKED = "asked AS (SELECT p_partkey AS id, p_name AS name, concat(" + ", ".join(
    ["CASE p_partkey % 22 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_AFFIXES)) + " END", "p_name", "CASE p_partkey % 22 " + " ".join(f"WHEN {i} THEN '{b}'".replace("'s", "''s") for i, (_, b) in enumerate(_AFFIXES)) + " END"]
) + ") AS query FROM part)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, query: queries of all kinds about the parts."""
    pick = lambda side: F.element_at(F.array(*[F.lit(x[side]) for x in _AFFIXES]), (F.col("p_partkey") % len(_AFFIXES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(pick(0), "p_name", pick(1)).alias("query"))


_TEXT = r"trim(regexp_replace(replace(lower(regexp_replace({0}, '([a-zA-Z0-9])''([a-zA-Z0-9])', '\1\2', 'g')), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_KIND_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join([f"contains(p, ' {x} ')" for x in phrases] + ([f"regexp_matches(p, '{T.PATTERN_FORMS[kind]}')"] if kind in T.PATTERN_FORMS else [])) + f" THEN '{kind}'" for kind, phrases in T.PATTERN_KINDS
) + " ELSE 'general' END"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + "]"
_THEME = "[" + ", ".join(f"'{w}'" for w in T.THEME_STOPWORDS) + "]"
_STEM = """CASE WHEN {0} IN ('surname', 'surnames') THEN 'name' WHEN {0} IN ('beginning', 'begins', 'started') THEN 'start' WHEN NOT regexp_full_match({0}, '[a-z]+') OR regexp_matches({0}, '(as|is|ss|us)$') OR length({0}) <= 4 THEN {0}
  WHEN ends_with({0}, 'ies') THEN concat({0}[:-4], 'y') WHEN ends_with({0}, 'xes') THEN {0}[:-3] WHEN ends_with({0}, 's') THEN {0}[:-2] ELSE {0} END"""


def _terms_sql(text: str, stop: str = _STOP) -> str:
    return f"list_distinct(list_filter(string_split({_TEXT.format(text)}, ' '), lambda w: (length(w) > 1 OR regexp_full_match(w, '[0-9]')) AND NOT list_contains({stop}, w)))"


@report("query_pattern_kinds", f"WITH {_ASKED}, k AS (SELECT id, concat(' ', {_TEXT.format('query')}, ' ') AS p FROM asked) SELECT id, {_KIND_SQL} AS kind FROM k")
def query_pattern_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", T.pattern_kind(F.col("query")).alias("kind"))


@report(
    "pattern_queries",
    f"""WITH {_ASKED}, d AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS impressions FROM lineitem GROUP BY 1), k AS (SELECT id, query, concat(' ', {_TEXT.format('query')}, ' ') AS p FROM asked)
    SELECT query, {_KIND_SQL} AS kind, sum(impressions)::BIGINT AS impressions, count(*) AS n_rows FROM k JOIN d USING (id) WHERE {_KIND_SQL} <> 'general' GROUP BY 1, 2 HAVING sum(impressions) >= 500""",
)
def pattern_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of the queries that follow a pattern."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("impressions"))
    rows = asked(spark, sf_dir).join(d, "id").groupBy("query").agg(F.sum("impressions").alias("impressions"), F.count("*").alias("n_rows")).filter("impressions >= 500")
    return rows.withColumn("kind", T.pattern_kind(F.col("query"))).filter("kind <> 'general'")


@report(
    "pattern_term_counts",
    f"""WITH {_ASKED}, t AS (SELECT id, unnest(list_distinct(list_transform({_terms_sql('query')}, lambda w: {_STEM.format('w')}))) AS term FROM asked), h AS (SELECT DISTINCT id, unnest({_terms_sql('query', _THEME)}) AS term FROM asked)
    SELECT term, count(*) AS n_queries, (SELECT count(*) FROM h WHERE h.term = t.term) AS n_themes FROM t GROUP BY term""",
)
def pattern_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed terms by the queries that have them, and by those that have the word itself as a theme."""
    q = asked(spark, sf_dir)
    terms = q.select(F.explode(F.array_distinct(F.transform(T.pattern_terms(F.col("query")), lambda w: T.stem(w)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_queries"))
    themes = q.select(F.explode(F.array_distinct(T.theme_terms(F.col("query")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_themes"))
    return terms.join(themes, "term", "left").fillna(0, ["n_themes"])


def _of_same(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns that values have for their keys, nulls among them."""
    named = values.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left").drop(*[f"_of_{k}" for k in keys])


def coverage_class(body: Column, title: Column, heading: Column, least: float = 0.75) -> Column:
    """Whether a page's body, or its title and heading, lack the words of a query."""
    return F.when(body < least, "body-term-review").when((title < least) | (heading < least), "serp-framing-review").otherwise("covered")


def _share_sql(text: str) -> str:
    t, h = f"list_transform({_terms_sql('query')}, lambda w: {_STEM.format('w')})", f"list_transform({_terms_sql(text)}, lambda w: {_STEM.format('w')})"
    return f"CASE WHEN len({t}) > 0 THEN len(list_filter({t}, lambda x: list_contains({h}, x)))::DOUBLE / len({t}) ELSE 0 END"


@report(
    "pattern_coverage",
    f"""WITH {_ASKED}, p AS (SELECT a.id, query, name AS title, concat('All ', name, 's') AS heading, concat(name, ' ', lower(p_type), ' ', lower(p_brand), ' price and reviews, guides') AS body FROM asked a JOIN part ON p_partkey = a.id),
    c AS (SELECT id, {_share_sql('title')} AS title, {_share_sql('heading')} AS heading, {_share_sql('body')} AS body FROM p)
    SELECT id, title, heading, body, CASE WHEN body < 0.75 THEN 'body-term-review' WHEN title < 0.75 OR heading < 0.75 THEN 'serp-framing-review' ELSE 'covered' END AS class FROM c""",
)
def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a query a page's title, heading and body have, by stemmed terms."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand")
    rows = asked(spark, sf_dir).join(parts, "id")
    # texts are read once, however many rows repeat them: each query and title, and each page of a query
    texts = ["query", "name", "p_type", "p_brand"]
    body = F.concat("name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.lower("p_brand"), F.lit(" price and reviews, guides"))
    q, framed = F.col("query"), rows.select("query", "name").distinct()
    framed = framed.select("query", "name", T.words_covered(q, F.col("name")).alias("title"), T.words_covered(q, F.concat(F.lit("All "), "name", F.lit("s"))).alias("heading"))
    told = rows.select(*texts).distinct().select(*texts, T.words_covered(q, body).alias("body"))
    rows = _of_same(_of_same(rows, framed, texts[:2]), told, texts).select("id", "title", "heading", "body")
    return rows.withColumn("class", coverage_class(F.col("body"), F.col("title"), F.col("heading")))


# --- templates ---------------------------------------------------------------------------------------------------------------------------

_PATTERN_ROWS = """rows_ AS (SELECT concat(p_name, ' ', lower(p_type)) AS query, concat('https://shop.example/', lower(p_type), '/', replace(CASE WHEN l_linenumber % 3 = 0 THEN 'other thing' ELSE p_name END, ' ', '-')) AS page, lower(p_type) AS type,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS impressions, sum(CAST(floor(l_quantity * l_discount + 0.5) AS BIGINT))::BIGINT AS clicks, sum((1 + (l_suppkey * 3 + l_linenumber) % 20) * CAST(l_quantity AS BIGINT))::BIGINT AS weighted
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, page, impressions, clicks, weighted (position times impressions): pages whose path names what they are about, most of the time."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    slug = F.replace(F.when(F.col("l_linenumber") % 3 == 0, "other thing").otherwise(F.col("p_name")), F.lit(" "), F.lit("-"))
    shown = F.col("l_quantity").cast("long")
    rows = j.select(
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("query"), F.concat(F.lit("https://shop.example/"), F.lower("p_type"), F.lit("/"), slug).alias("page"), shown.alias("impressions"),
        F.floor(F.col("l_quantity") * F.col("l_discount") + 0.5).cast("long").alias("clicks"), ((1 + (F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 20) * shown).alias("weighted"),
    )
    return rows.groupBy("query", "page").agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "weighted")])


def template_verdict() -> Column:
    """What a template needs first: index risk, crawl risk, content review, opportunity, healthy, inconclusive, no data."""
    c = F.col
    conclusive = c("indexed") + c("not_indexed")
    return (
        F.when((c("not_indexed") > 0) & ((conclusive == 1) | (c("not_indexed") / conclusive >= 0.5)), "index-risk")
        .when((c("failed") > 0) & ((c("attempted") == 1) | (c("failed") / c("attempted") >= 0.5)), "crawl-risk")
        .when((c("usable") >= 3) & ((c("weak") / c("usable") >= 0.5) | (c("same_titles") >= 2)), "content-review")
        .when((c("impressions") > 0) & ((c("position") > 8) | ((c("position") <= 10) & (c("ctr") < 0.01)) | ((c("checked") >= 10) & (c("fit") < 0.35))), "opportunity")
        .when((conclusive >= 2) & (c("indexed") == conclusive) & (c("usable") >= 2) & (c("failed") == 0), "healthy")
        .when(c("impressions") > 0, "inconclusive")
        .otherwise("no-data")
    )


@report(
    "template_verdicts",
    f"""WITH {_PATTERN_ROWS}, f AS (SELECT *, concat('/', type, '/:slug') AS template, list_has_any(list_transform({_terms_sql('query')}, lambda w: {_STEM.format('w')}), list_transform({_terms_sql("regexp_replace(page, '^.*/', '')", _THEME)}, lambda w: {_STEM.format('w')})) AS fits FROM rows_),
    m AS (SELECT template, any_value(type) AS type, count(DISTINCT page) AS n_pages, sum(impressions)::BIGINT AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr, sum(weighted)::DOUBLE / sum(impressions) AS position, count(*) AS checked, sum(CASE WHEN fits THEN impressions ELSE 0 END)::DOUBLE / sum(impressions) AS fit FROM f GROUP BY 1),
    s AS (SELECT *, length(type) % 3 AS indexed, length(type) % 4 AS not_indexed, 6 AS attempted, length(type) % 7 AS failed, 6 - length(type) % 7 AS usable, length(type) % 2 AS weak, length(type) % 3 AS same_titles FROM m)
    SELECT template, n_pages, impressions, ctr, position, fit, CASE WHEN not_indexed > 0 AND (indexed + not_indexed = 1 OR not_indexed::DOUBLE / (indexed + not_indexed) >= 0.5) THEN 'index-risk' WHEN failed > 0 AND failed::DOUBLE / attempted >= 0.5 THEN 'crawl-risk'
      WHEN usable >= 3 AND (weak::DOUBLE / usable >= 0.5 OR same_titles >= 2) THEN 'content-review' WHEN impressions > 0 AND (position > 8 OR (position <= 10 AND ctr < 0.01) OR (checked >= 10 AND fit < 0.35)) THEN 'opportunity'
      WHEN indexed + not_indexed >= 2 AND not_indexed = 0 AND usable >= 2 AND failed = 0 THEN 'healthy' WHEN impressions > 0 THEN 'inconclusive' ELSE 'no-data' END AS verdict FROM s""",
)
def template_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with what search shows of their pages, how well their paths fit the queries, and a verdict. Inspections are a fixture."""
    rows = pattern_rows(spark, sf_dir)
    terms = lambda words: F.transform(words, lambda w: T.stem(w))
    slug = F.element_at(path_parts(F.col("page")), -1)
    fits = F.arrays_overlap(terms(T.pattern_terms(F.col("query"))), terms(T.theme_terms(slug)))
    m = rows.select("*", url_signature(F.col("page")).alias("template"), fits.alias("fits"))
    total = F.sum("impressions")
    m = m.groupBy("template").agg(
        F.countDistinct("page").alias("n_pages"), total.alias("impressions"), (F.sum("clicks") / total).alias("ctr"), (F.sum("weighted") / total).alias("position"), F.count("*").alias("checked"), (F.sum(F.when(F.col("fits"), F.col("impressions")).otherwise(0)) / total).alias("fit")
    )
    k = F.length(F.regexp_extract("template", "^/([^/]*)", 1))
    facts = {"indexed": k % 3, "not_indexed": k % 4, "attempted": F.lit(6), "failed": k % 7, "usable": 6 - k % 7, "weak": k % 2, "same_titles": k % 3}
    return m.withColumns(facts).select("template", "n_pages", "impressions", "ctr", "position", "fit", template_verdict().alias("verdict"))


@report(
    "dominant_templates",
    f"""WITH {_PATTERN_ROWS}, t AS (SELECT query, concat('/', type, '/:slug') AS template, CASE WHEN contains(page, 'other-thing') THEN 'other' ELSE 'own' END AS kind FROM rows_), n AS (SELECT template, kind, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT template, kind, n, n::DOUBLE / sum(n) OVER (PARTITION BY template) AS share FROM n QUALIFY row_number() OVER (PARTITION BY template ORDER BY n DESC, kind) = 1""",
)
def dominant_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest kind of page of a template and its share; of kinds that tie, the first by name."""
    kind = F.when(F.col("page").contains("other-thing"), "other").otherwise("own")
    n = pattern_rows(spark, sf_dir).groupBy(url_signature(F.col("page")).alias("template"), kind.alias("kind")).agg(F.count("*").alias("n"))
    g = n.groupBy("template").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return g.select("template", "kind", "n", (F.col("n") / F.col("total")).alias("share"))


@report(
    "competitor_patterns",
    f"""WITH {_PATTERN_ROWS}, r AS (SELECT DISTINCT concat('supplier-', l_suppkey % 20, '.example') AS domain, concat('https://supplier/', lower(p_type), '/', replace(p_name, ' ', '-')) AS page, lower(p_type) AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
    o AS (SELECT concat('/', type, '/:slug') AS template, sum(impressions)::BIGINT AS own FROM rows_ GROUP BY 1)
    SELECT domain, template, n_pages, own FROM (SELECT domain, concat('/', type, '/:slug') AS template, count(*) AS n_pages FROM r GROUP BY 1, 2) LEFT JOIN o USING (template) WHERE n_pages >= 3""",
)
def competitor_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the pages of each competitor, beside the demand that one's own pages of the same template meet."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    page = F.concat(F.lit("https://supplier/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    r = j.select(F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example")).alias("domain"), page.alias("page")).distinct()
    own = pattern_rows(spark, sf_dir).groupBy(url_signature(F.col("page")).alias("template")).agg(F.sum("impressions").alias("own"))
    n = r.groupBy("domain", url_signature(F.col("page")).alias("template")).agg(F.count("*").alias("n_pages")).filter("n_pages >= 3")
    return n.join(own, "template", "left").select("domain", "template", "n_pages", "own")


@report(
    "search_overview",
    f"""WITH {SEARCH_ROWS}, w AS (SELECT CASE WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'current' WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'previous' END AS period, * FROM search_rows)
    SELECT period, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr, sum(position * impressions)::DOUBLE / sum(impressions) AS position, count(DISTINCT query) AS n_queries, count(DISTINCT page) AS n_pages FROM w WHERE period IS NOT NULL GROUP BY 1""",
)
def search_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search brought in a period and in the one before."""
    d = F.col("date")
    period = F.when(d.between("1999-01-01", "1999-12-31"), "current").when(d.between("1998-01-01", "1998-12-31"), "previous")
    rows = search_rows(spark, sf_dir).filter(d.between("1998-01-01", "1999-12-31")).withColumn("period", period)
    total = F.sum("impressions")
    return rows.groupBy("period").agg(F.sum("clicks").alias("clicks"), total.alias("impressions"), (F.sum("clicks") / total).alias("ctr"), (F.sum(F.col("position") * F.col("impressions")) / total).alias("position"), F.countDistinct("query").alias("n_queries"), F.countDistinct("page").alias("n_pages"))


@report("query_page_share", f"WITH {QUERY_PAGE} SELECT query, max(impressions)::DOUBLE / sum(impressions) AS top_share, arg_min(page, struct_pack(i := -impressions, p := page)) AS top_page FROM query_page GROUP BY 1")
def query_page_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a query's impressions mostly go to, and its share."""
    return query_page(spark, sf_dir).groupBy("query").agg((F.max("impressions") / F.sum("impressions")).alias("top_share"), F.min_by("page", F.struct(-F.col("impressions"), F.col("page"))).alias("top_page"))


# --- benchmarks without a group ------------------------------------------------------------------------------------------------------------


def _group_sql(source: str, groups: str) -> str:
    return f"""WITH {QUERY_PAGE}, r AS (SELECT *, greatest(1, least(10, floor(position + 0.5)))::INT AS bucket, regexp_replace(page, '/+$', '') AS url_key FROM query_page), g AS ({groups}), gs AS (SELECT DISTINCT grp FROM g),
    u AS (SELECT gs.grp, bucket, url_key, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM r, gs WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.grp = gs.grp AND g.query = r.query AND g.page = r.page) GROUP BY 1, 2, 3 HAVING sum(impressions) >= 30),
    s AS (SELECT grp, bucket, sum(impressions) AS i, count(*) AS n, count(*) FILTER (WHERE clicks > 0) AS p, quantile_disc(clicks::DOUBLE / impressions, 0.75) FILTER (WHERE clicks > 0) AS q FROM u GROUP BY 1, 2),
    c AS (SELECT grp, b AS bucket, [0.27, 0.15, 0.10, 0.07, 0.05, 0.035, 0.025, 0.02, 0.015, 0.012][b]::DOUBLE AS curve FROM gs, (SELECT unnest(range(1, 11))::INT AS b)),
    t AS (SELECT c.grp, c.bucket, curve, CASE WHEN i >= 1000 AND n >= 5 AND p >= 3 THEN q END AS q FROM c LEFT JOIN s ON s.grp = c.grp AND s.bucket = c.bucket)
    SELECT grp, bucket, min(floor(CASE WHEN q IS NULL THEN curve ELSE greatest(curve * 0.5, least(q, curve * 1.5)) END * 10000 + 0.5) / 10000) OVER (PARTITION BY grp ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS target, q IS NOT NULL AS from_site FROM t"""


@report("ctr_benchmark_group_out", _group_sql("query_page", "SELECT split_part(query, ' ', 1) AS grp, query, page FROM query_page"))
def ctr_benchmark_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates to reach for each first word of the queries, its own rows left out."""
    rows = query_page_table(spark, sf_dir)
    return leave_group_out(rows, rows.select(F.element_at(F.split("query", " "), 1).alias("grp"), "query", "page"))


@report("ctr_benchmark_row_out", _group_sql("query_page", "SELECT concat(query, ' @ ', page) AS grp, query, page FROM query_page"))
def ctr_benchmark_row_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates to reach for each row, itself left out. In SQL every row meets all others."""
    rows = query_page_table(spark, sf_dir)
    return leave_group_out(rows, rows.select(F.concat_ws(" @ ", "query", "page").alias("grp"), "query", "page"))


# --- structured data ---------------------------------------------------------------------------------------------------------------------

#: A block for each page, as a fixture, in the same text for both engines.
_LD = """CASE page_id % 8 WHEN 0 THEN '{"@context":"https://schema.org","@type":"Product","name":"A","offers":{"price":1}}' WHEN 1 THEN '{"@type":"Product","name":"A"}' WHEN 2 THEN '{"@graph":[{"@type":"Organization","name":"O","url":"https://o.example","logo":"l","sameAs":["a","b"]},{"@type":"BreadcrumbList"}]}'
  WHEN 3 THEN '[{"@type":["Event","Thing"],"name":"E","startDate":"2024-01-01"}]' WHEN 4 THEN '{"@type":"Recipe",' WHEN 5 THEN '{"@type":"https://schema.org/VideoObject","name":"V","thumbnailUrl":"t","uploadDate":""}' WHEN 6 THEN '{"@type":"Organization","name":"O"}' ELSE '' END"""
_HTML = f"concat('<html><script type=\"application/ld+json\">', {_LD}, '</script></html>')"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr(f"CASE WHEN page_id % 8 = 7 THEN '<html></html>' ELSE {_HTML} END")
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


_ITEMS = f"""b AS (SELECT page_id, {_LD} AS b FROM pages WHERE page_id % 8 <> 7), v AS (SELECT page_id, b, json_valid(b) AS ok FROM b),
items AS (SELECT page_id, unnest(CASE WHEN starts_with(b, '[') THEN CAST(b::JSON AS JSON[]) WHEN json_exists(b, '$."@graph"') THEN CAST(json_extract(b, '$."@graph"') AS JSON[]) ELSE [b::JSON] END) AS item FROM v WHERE ok),
typed AS (SELECT page_id, item, unnest(CASE WHEN json_type(item, '$."@type"') = 'ARRAY' THEN CAST(json_extract(item, '$."@type"') AS VARCHAR[]) ELSE [json_extract_string(item, '$."@type"')] END) AS raw FROM items),
named AS (SELECT page_id, item, regexp_replace(raw, '^.*[/#]', '') AS type FROM typed)"""


@report("structured_data", f"WITH {_ITEMS}, n AS (SELECT page_id, list_sort(list(type)) AS types FROM named GROUP BY 1) SELECT p.page_id, coalesce(types, []) AS types, CASE WHEN v.ok IS NULL OR v.ok THEN 0 ELSE 1 END AS n_invalid FROM pages p LEFT JOIN n USING (page_id) LEFT JOIN v USING (page_id)")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that the pages declare, and their broken blocks."""
    each = structured.blocks(F.col("html"))
    types = F.flatten(F.transform(F.flatten(F.transform(each, structured.items_of)), structured.types_of))
    return described(spark, sf_dir).select("page_id", F.array_sort(types).alias("types"), F.size(F.filter(each, lambda b: ~structured.is_json(b))).alias("n_invalid"))


def _lacks_sql() -> str:
    has = lambda n: f"coalesce(json_extract_string(item, '$.{n}') NOT IN ('', '[]', '{{}}', 'null'), FALSE)"
    lacks = lambda names: f"CASE WHEN NOT ({' OR '.join(map(has, names.split('|')))}) THEN '{names}' END"
    return "CASE type " + " ".join(f"WHEN '{t}' THEN list_filter([{', '.join(map(lacks, names))}], lambda x: x IS NOT NULL)" for t, names in structured.REQUIRED.items()) + " END"


@report("rich_results", f"WITH {_ITEMS}, m AS (SELECT page_id, type, {_lacks_sql()} AS missing FROM named) SELECT page_id, type, missing, CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'missing-required-properties' END AS status FROM m WHERE missing IS NOT NULL")
def rich_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the items of known types still need for a rich result."""
    rows = structured.extract(described(spark, sf_dir), "page_id").select("page_id", "type", structured.missing_properties(F.col("item"), F.col("type")).alias("missing")).filter("missing is not null")
    return rows.withColumn("status", F.when(F.size("missing") == 0, "complete").otherwise("missing-required-properties"))


@report(
    "entity_readiness",
    f"""WITH {_ITEMS}, o AS (SELECT page_id, (json_extract_string(item, '$.name') IS NOT NULL)::INT + (json_extract_string(item, '$.url') IS NOT NULL)::INT + (json_extract_string(item, '$.logo') IS NOT NULL)::INT + (coalesce(json_array_length(item, '$.sameAs'), 0) >= 2)::INT AS met FROM named WHERE type IN ('Organization', 'LocalBusiness', 'Person'))
    SELECT page_id, max(met) AS met, CASE WHEN max(met) = 4 THEN 'ready' WHEN max(met) >= 2 THEN 'partial' ELSE 'weak' END AS status FROM o GROUP BY 1""",
)
def entity_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well pages say who stands behind them: name, url, logo and two other profiles of an organization or person."""
    rows = structured.extract(described(spark, sf_dir), "page_id").filter(F.col("type").isin("Organization", "LocalBusiness", "Person"))
    item = F.col("item")
    profiles = F.coalesce(F.size(F.from_json(item["sameAs"], "array<string>")), F.lit(0))
    met = sum(item[k].isNotNull().cast("int") for k in ("name", "url", "logo")) + (profiles >= 2).cast("int")
    best = rows.groupBy("page_id").agg(F.max(met).alias("met"))
    return best.withColumn("status", F.when(F.col("met") == 4, "ready").when(F.col("met") >= 2, "partial").otherwise("weak"))


# --- items of any format, at any depth ---------------------------------------------------------------------------------------------------

#: A page's items as a fixture, by the remainder of its number: html, and (format, path, types, name, same_as) of its items.
_ITEM_PAGES = [
    (
        """<script type="application/ld+json">{"@context":{"@vocab":"https://schema.org/","s":"http://schema.org/"},"@graph":[{"@type":"s:Organization","name":"O","sameAs":["https://a.test/1","not a link","http://b.test"],"founder":{"@type":["Person","x:y"],"name":"F","sameAs":"https://a.test/2"}},{"name":"untyped"}]}</script>""",
        [("json-ld", "$.@graph[0]", "Organization", "O", ["https://a.test/1", "http://b.test"]), ("json-ld", "$.@graph[0].founder", "Person", "F", ["https://a.test/2"])],
    ),
    (
        """<DIV itemscope ITEMTYPE="https://schema.org/Product https://other.test/T"><h2 itemprop="name">A <i>B</i></h2><link itemprop=sameAs href="https://a.test/3"><p itemprop="offers" itemscope itemtype=http://schema.org/Offer><meta itemprop="name" content="N &amp; M"><br></p><span itemprop="brand">after</span></div>""",
        [("microdata", "$microdata[0]", "Product", "A B", ["https://a.test/3"]), ("microdata", "$microdata[0].offers[0]", "Offer", "N & M", [])],
    ),
    (
        """<section prefix="sc: https://schema.org/ o: https://other.test/"><div typeof="sc:Event o:Thing" resource="#e"><b property="name">E</b><a property="sameAs" href=https://a.test/4>x</a></div></section><ul vocab="http://schema.org/"><li typeof=Person><i property=name>P<li typeof=Place></ul>""",
        [("rdfa", "$rdfa[0]", "Event", "E", ["https://a.test/4"]), ("rdfa", "$rdfa[1]", "Person", "P", []), ("rdfa", "$rdfa[2]", "Place", None, [])],
    ),
    ("""<!-- <div itemscope itemtype="https://schema.org/Thing"> --><script>var x = "<div itemscope>";</script><div itemscope></div>""", [("microdata", "$microdata[0]", "", None, [])]),
    ("""<script type="application/ld+json">{"@type": "Thing", </script>""", []),
]
_ITEMS_OF = "p AS (SELECT page_id, page_id % 5 AS k FROM pages), items(k, format, path, types, name, same_as) AS (VALUES " + ", ".join(
    f"({k}, '{form}', '{path}', '{types}', {'NULL' if name is None else chr(39) + name + chr(39)}, {links}::VARCHAR[])" for k, (_, found) in enumerate(_ITEM_PAGES) for form, path, types, name, links in found
) + ")"


def page_items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and each item of the page."""
    made = F.element_at(F.array(*[F.lit(html) for html, _ in _ITEM_PAGES]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<article>"), F.concat(made, F.lit("<article>"))).alias("html"))
    return extracted(pages, "page_id").select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")


@report("page_items", f"WITH {_ITEMS_OF} SELECT page_id, format, path, types, name FROM p JOIN items USING (k)")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the pages as JSON-LD, microdata and RDFa, nested ones too, with where they stand."""
    return page_items_table(spark, sf_dir).select("page_id", "format", "path", F.array_join("types", ",").alias("types"), F.col("props")["name"].alias("name"))


@report("same_as_links", f"WITH {_ITEMS_OF} SELECT page_id, concat(path, '.sameAs') AS path, types, unnest(same_as) AS url FROM p JOIN items USING (k)")
def same_as_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses the typed items say they are the same as."""
    rows = page_items_table(spark, sf_dir).filter(F.size("types") > 0)
    each = rows.select("page_id", F.concat("path", F.lit(".sameAs")).alias("path"), F.array_join("types", ",").alias("types"), F.explode("same_as").alias("url"))
    return each.filter(F.col("url").rlike(r"(?i)^https?://[^/\s]+"))
