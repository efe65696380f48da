"""Matches of queries, prompts, pages and links by words, paths and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import broad_signature, path_parts, url_signature
from ..functions.html import extracted
from ..operators.graph import resolve_aliases
from ..operators.ranks import ranked
from ..operators.tables import written
from ..sources.views import QUERY_PAGE, query_page, table
from .page_rules import _FINDINGS, RULES, RULES_SQL, found
from .pattern_reports import _ASKED, _KIND_SQL, _STEM, _TEXT, _terms_sql, asked

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@report(
    "top_recommendations",
    f"""WITH {_FINDINGS}, {RULES_SQL}, r AS (SELECT page_id % 7 AS run, page_id, rule, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS s FROM found JOIN rules USING (rule))
    SELECT run, rule, page_id FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY s, page_id, rule) = 1""",
)
def top_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each crawl the finding that matters most, the earliest among equals."""
    rules = spark.createDataFrame(RULES, "rule string, category string, severity string, kind string")
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = found(spark, sf_dir).join(F.broadcast(rules), "rule").select((F.col("page_id") % 7).alias("run"), "rule", "page_id", severity.alias("s"))  # the rules are a fixed table
    best = rows.groupBy("run").agg(F.min_by(F.struct("rule", "page_id"), F.struct("s", "page_id", "rule")).alias("b"))
    return best.select("run", "b.rule", "b.page_id")


@report(
    "weighted_positions",
    """WITH r AS (SELECT p_name AS query, CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS impressions, 1 + (l_suppkey * 3 + l_linenumber) % 20 AS position FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT query, sum(impressions)::BIGINT AS impressions, sum(position * greatest(impressions, 1))::DOUBLE / sum(greatest(impressions, 1)) AS position FROM r GROUP BY 1""",
)
def weighted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions weighted by impressions; rows without any count once."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    shown = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_quantity").cast("long"))
    rows = j.select(F.col("p_name").alias("query"), shown.alias("impressions"), (1 + (F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 20).alias("position"))
    weight = F.greatest("impressions", F.lit(1))
    return rows.groupBy("query").agg(F.sum("impressions").alias("impressions"), (F.sum(F.col("position") * weight) / F.sum(weight)).alias("position"))


_PATHS = r"paths AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)"


@report(
    "template_containment",
    f"""WITH {_PATHS}, s AS (SELECT page_id, parts, concat('/', lower(parts[1]), '/', CASE WHEN regexp_full_match(parts[2], '[0-9]+') THEN ':num' ELSE lower(parts[2]) END) AS fine, CASE WHEN regexp_full_match(parts[2], '[0-9]+') THEN concat('/', lower(parts[1]), '/:num') ELSE concat('/', lower(parts[1]), '/:value') END AS broad FROM paths),
    known AS (SELECT fine, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 10), wide AS (SELECT broad, count(*) AS n FROM s GROUP BY 1)
    SELECT page_id, coalesce(known.fine, wide.broad) AS template, known.fine IS NOT NULL AS exact FROM s LEFT JOIN known ON known.fine = s.fine LEFT JOIN wide ON wide.broad = s.broad""",
)
def template_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that a page belongs to: that of its own form where ten pages have it, else the broad one of its section."""
    rows = table(spark, sf_dir, "pages").select("page_id", url_signature(F.col("url")).alias("fine"), broad_signature(F.col("url")).alias("broad"))
    known = rows.groupBy("fine").agg(F.count("*").alias("n")).filter("n >= 10").select("fine", F.lit(True).alias("exact"))
    wide = rows.select("broad").distinct().withColumn("wide", F.col("broad"))
    both = rows.join(known, "fine", "left").join(wide, "broad", "left")
    return both.select("page_id", F.when(F.col("exact"), F.col("fine")).otherwise(F.col("wide")).alias("template"), F.coalesce("exact", F.lit(False)).alias("exact"))


ALIASES = ["red widget", "bolt", "big ring"]


@report("alias_mentions", f"WITH {_ASKED} SELECT regexp_matches(lower(query), '(^|[^a-z0-9])(red widget|bolt|big ring)($|[^a-z0-9])') AS mentioned, count(*) AS n FROM asked GROUP BY 1")
def alias_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).groupBy(T.mentions(F.col("query"), ALIASES).alias("mentioned")).agg(F.count("*").alias("n"))


@report(
    "phrase_coverage",
    f"""WITH {_ASKED}, p AS (SELECT a.id, list_distinct(string_split({_TEXT.format('query')}, ' ')) AS terms, string_split(concat(p_name, 's and guides for ', lower(p_type)), ' ') AS words FROM asked a JOIN part ON p_partkey = a.id)
    SELECT id, len(list_filter(terms, lambda t: len(list_filter(words, lambda w: starts_with(w, t))) > 0))::DOUBLE / len(terms) AS coverage FROM p""",
)
def phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a query's words with which a word of the text begins."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat("p_name", F.lit("s and guides for "), F.lower("p_type")), " ").alias("words"))
    terms = F.array_distinct(F.split(T.pattern_text(F.col("query")), " "))
    return asked(spark, sf_dir).join(parts, "id").select("id", T.term_coverage(terms, F.col("words")).alias("coverage"))


@report(
    "local_analytics",
    f"""WITH {QUERY_PAGE}, o AS (SELECT page, regexp_replace(page, '^https?://[^/]*', '') AS path, sum(impressions)::BIGINT AS impressions FROM query_page WHERE position > 5 GROUP BY 1, 2),
    g AS (SELECT concat('/', lower(p_type), '/supplier-', l_suppkey % 10) AS path, l_linestatus AS region, count(*) AS sessions FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2)
    SELECT page, impressions, region, coalesce(sessions, 0) AS sessions FROM o LEFT JOIN g USING (path)""",
)
def local_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by region of the pages that rank low, by their path."""
    o = query_page(spark, sf_dir).filter("position > 5").groupBy("page").agg(F.sum("impressions").alias("impressions")).withColumn("path", F.regexp_replace("page", "^https?://[^/]*", ""))
    j = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/supplier-"), (F.col("l_suppkey") % 10).cast("string"))
    g = j.groupBy(path.alias("path"), F.col("l_linestatus").alias("region")).agg(F.count("*").alias("sessions"))
    return o.join(g, "path", "left").select("page", "impressions", "region", F.coalesce("sessions", F.lit(0)).alias("sessions"))


#: Postings of a thing or term that are used, matches that a prompt keeps; parts that the pages of a thing are dealt to.
MOST_POSTINGS, MOST_MATCHES, SALTS = 100, 3, 16
#: Queries of up to so many terms meet by subsets of these, longer ones term by term.
FEW_TERMS = 10


def first_of_each(rows: DataFrame, key: str, order: list, k: int, parts: int = 32) -> DataFrame:
    """The first k rows of each key: of each part of its rows, then of all, so that a common key doesn't fill one task."""
    kept = rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(parts)))
    for keys in ([key, "_part"], [key]):
        kept = kept.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= k)
    return kept.drop("_part", "_k")


@report(
    "prompt_matches",
    f"""WITH {_ASKED}, q AS (SELECT id, {_terms_sql('query')} AS terms FROM asked), t AS (SELECT id, unnest(terms) AS term FROM q),
    m AS (SELECT a.id, b.id AS match, count(*) AS shared FROM t a JOIN t b USING (term) WHERE a.id % 10 = 0 AND b.id % 10 <> 0 GROUP BY 1, 2)
    SELECT id, match, shared FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, match) <= {MOST_MATCHES}""",
)
def prompt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three queries that share most terms with each prompt, of all queries."""
    t = asked(spark, sf_dir).select("id", F.posexplode(T.pattern_terms(F.col("query"))).alias("at", "term"))
    return matched_prompts(t.filter("id % 10 = 0"), t.filter("id % 10 <> 0"))


def matched_prompts(prompts: DataFrame, rows: DataFrame, most_retained: int | None = None) -> DataFrame:
    """id, match, shared from the terms of prompts and of rows (id, at, term): the first MOST_MATCHES by shared terms, then by id.

    A match that shares the terms S with a prompt is among the first MOST_MATCHES rows that have all of S: any before it share as much and
    rank higher. So a prompt looks up the first rows of each subset of its terms, and no pair of a prompt and a row is made. Ids of more
    than FEW_TERMS terms, or with a repeated one (each counts), meet the others term by term. Prompts and rows of the same terms count as one.
    With most_retained a term's list holds its first MOST_POSTINGS rows, all lists together the first most_retained of these; without, all rows.
    """
    if most_retained is not None:
        rows = first_of_each(rows.select("id", "at", "term"), "term", [F.col("id"), F.col("at")], MOST_POSTINGS)
        rows = ranked(rows, [], [F.col("id"), F.col("at"), F.col("term")], "n").filter(F.col("n") <= most_retained)
    listed = lambda df: df.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    few = (F.size("terms") <= FEW_TERMS) & (F.size("terms") == F.size(F.array_distinct("terms")))
    asked_for = written(listed(prompts), "prompts")
    asking = asked_for.select("terms").distinct().withColumn("few", few)
    # of the rows of the same terms, only the first can be matches
    kinds = written(first_of_each(listed(rows), "terms", [F.col("id")], MOST_MATCHES).select("terms", F.col("id").alias("match"), few.alias("few")), "kinds")
    subsets = F.aggregate("terms", F.array(F.array().cast("array<string>")), lambda found, term: F.concat(found, F.transform(found, lambda s: F.array_append(s, term))))
    subset = F.explode(F.filter(subsets, lambda s: F.size(s) > 0)).alias("subset")
    first = first_of_each(kinds.filter("few").select(subset, "match"), "subset", [F.col("match")], MOST_MATCHES)
    met = asking.filter("few").select("terms", subset).join(first, "subset").groupBy("terms", "match").agg(F.max(F.size("subset")).cast("long").alias("shared"))
    term = lambda df, *columns: df.select(*columns, F.explode("terms").alias("term"))
    for some, others in ((asking.filter("few"), kinds.filter("NOT few")), (asking.filter("NOT few"), kinds)):
        met = met.union(term(some, "terms").join(term(others, "match"), "term").groupBy("terms", "match").agg(F.count("*").alias("shared")))
    best = met.withColumn("k", F.row_number().over(W.partitionBy("terms").orderBy(F.desc("shared"), "match"))).filter(F.col("k") <= MOST_MATCHES).drop("k")
    return asked_for.join(best, "terms").select("id", "match", "shared")


@report(
    "link_verification",
    f"""WITH {QUERY_PAGE}, d AS (SELECT page, arg_max(query, struct_pack(i := impressions, q := query)) AS query, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1),
    w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY split_part(query, ' ', 2) ORDER BY impressions DESC, page) <= {MOST_POSTINGS}),
    c AS (SELECT s.page AS source, t.page AS target, s.query = t.query AS exact, t.impressions FROM d s JOIN w t ON split_part(s.query, ' ', 2) = split_part(t.query, ' ', 2) AND s.page <> t.page),
    l AS (SELECT page AS source, concat(regexp_replace(page, '[0-9]+$', ''), (CAST(regexp_extract(page, '([0-9]+)$', 1) AS INT) + 1) % 10) AS target FROM d)
    SELECT c.source, c.target, exact, floor(100 * exact::INT + 10 * log10(impressions + 1) + 10 * CASE WHEN exact THEN 1.0 ELSE 0.5 END + 0.5)::BIGINT AS priority FROM c LEFT JOIN l ON l.source = c.source AND l.target = c.target WHERE l.source IS NULL""",
)
def link_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pages could have to others about the same thing, without those they have, by priority. The MOST_POSTINGS most shown pages
    of a thing are its targets, as many as the operator has for each."""
    d = query_page(spark, sf_dir).groupBy("page").agg(F.max_by("query", F.struct("impressions", "query")).alias("query"), F.sum("impressions").alias("impressions"))
    named = d.withColumn("thing", F.element_at(F.split("query", " "), 2))
    s, t = named.select("thing", F.col("page").alias("source"), F.col("query").alias("source_query")), named.select("thing", F.col("page").alias("target"), F.col("query").alias("target_query"), "impressions")
    t = first_of_each(t, "thing", [F.desc("impressions"), F.col("target")], MOST_POSTINGS)
    # the pages of a common thing are dealt out, its few targets go to all parts
    s = s.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    t = t.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    number = F.regexp_extract("page", "([0-9]+)$", 1).cast("int")
    has = d.select(F.col("page").alias("source"), F.concat(F.regexp_replace("page", "[0-9]+$", ""), ((number + 1) % 10).cast("string")).alias("target"))
    c = s.join(t, ["thing", "part"]).filter("source <> target").join(has, ["source", "target"], "left_anti").withColumn("exact", F.col("source_query") == F.col("target_query"))
    priority = F.floor(100 * F.col("exact").cast("int") + 10 * F.log10(F.col("impressions") + 1) + 10 * F.when(F.col("exact"), 1.0).otherwise(0.5) + 0.5)
    return c.select("source", "target", "exact", priority.alias("priority"))


@report(
    "pattern_opportunities",
    f"""WITH {_ASKED}, d AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS impressions, sum(CAST(floor(l_quantity * l_discount + 0.5) AS BIGINT))::BIGINT AS clicks FROM lineitem GROUP BY 1), k AS (SELECT id, concat(' ', {_TEXT.format('query')}, ' ') AS p, {_STEM.format("split_part(name, ' ', 2)")} AS entity FROM asked),
    g AS (SELECT {_KIND_SQL} AS kind, count(DISTINCT entity) AS n_entities, count(*) AS n_queries, sum(impressions)::BIGINT AS impressions, sum(clicks)::DOUBLE / sum(impressions) AS ctr FROM k JOIN d USING (id) GROUP BY 1)
    SELECT kind, n_entities, n_queries, impressions, ctr, CASE WHEN kind = 'general' THEN 'no-pattern' WHEN n_entities >= 5 AND impressions >= 10000 THEN 'build' WHEN n_entities >= 3 THEN 'test' ELSE 'wait' END AS verdict FROM g""",
)
def pattern_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of queries by the things that they are about and by their demand: whether pages of a pattern would pay."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("impressions"), F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") + 0.5).cast("long")).alias("clicks"))
    k = asked(spark, sf_dir).select("id", T.pattern_kind(F.col("query")).alias("kind"), T.stem(F.element_at(F.split("name", " "), 2)).alias("entity"))
    total = F.sum("impressions")
    g = k.join(d, "id").groupBy("kind").agg(F.countDistinct("entity").alias("n_entities"), F.count("*").alias("n_queries"), total.alias("impressions"), (F.sum("clicks") / total).alias("ctr"))
    verdict = F.when(F.col("kind") == "general", "no-pattern").when((F.col("n_entities") >= 5) & (F.col("impressions") >= 10_000), "build").when(F.col("n_entities") >= 3, "test").otherwise("wait")
    return g.withColumn("verdict", verdict)


@report("path_depths", f"WITH {_PATHS} SELECT len(parts) AS depth, count(*) AS n FROM paths GROUP BY 1")
def path_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.size(path_parts(F.col("url"))).alias("depth")).agg(F.count("*").alias("n"))


# --- links that are missing ----------------------------------------------------------------------------------------------------------------


def link_gaps(pages: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """source, target, state, n_inlinks: pages (source, words) beside the targets that their words name, and whether a link is missing.

    links: src, dst. aliases: src, dst; where chains of them end is the target that counts. A target is named by the last part of its
    address; `existing-link` where the page links to it or to one of its aliases, `self-alias` where the page is the target itself,
    else `missing`. A word meets the one target of its name, so common words give as many rows as pages have them.
    """
    ends = written(resolve_aliases(aliases), "aliases")
    of = lambda rows, column: rows.join(ends.select(F.col("src").alias(column), F.col("target").alias("_end")), column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")
    graph = written(of(of(links.select("src", "dst"), "dst"), "src").distinct(), "links")
    targets = graph.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n_inlinks"))
    named = targets.withColumn("word", F.lower(F.regexp_extract("target", r"([^/]+)/?$", 1))).filter("word <> ''")
    first = named.groupBy("word").agg(F.max_by(F.struct("target", "n_inlinks"), F.struct("n_inlinks", "target")).alias("t")).select("word", "t.*")
    said = of(pages, "source").select("source", F.explode(F.array_distinct(F.transform("words", lambda w: F.lower(w)))).alias("word"))
    met = said.join(first, "word").select("source", "target", "n_inlinks").distinct()
    known = graph.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(True).alias("linked"))
    state = F.when(F.col("source") == F.col("target"), "self-alias").when(F.col("linked"), "existing-link").otherwise("missing")
    return met.join(known, ["source", "target"], "left").select("source", "target", state.alias("state"), "n_inlinks")


@report(
    "missing_links",
    rf"""WITH l AS (SELECT DISTINCT concat('/p/', page_id) AS src, unnest(regexp_extract_all(html, '<a href="([^"#?]+)', 1)) AS dst FROM pages), g AS (SELECT DISTINCT src, regexp_replace(dst, '[^\p{{L}}\p{{N}}/]+$', '') AS dst FROM l),
    t AS (SELECT dst AS target, count(*) AS n_inlinks, lower(regexp_extract(dst, '([^/]+)/?$', 1)) AS word FROM g GROUP BY 1), f AS (SELECT word, max_by(target, struct_pack(n := n_inlinks, t := target)) AS target, max(n_inlinks) AS n_inlinks FROM t WHERE word <> '' GROUP BY 1),
    s AS (SELECT DISTINCT concat('/p/', page_id) AS source, lower(unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\p{{L}}\p{{N}}]+'))) AS word FROM pages)
    SELECT DISTINCT s.source, f.target, CASE WHEN g.src IS NOT NULL THEN 'existing-link' ELSE 'missing' END AS state, f.n_inlinks FROM s JOIN f USING (word) LEFT JOIN g ON g.src = s.source AND g.dst = f.target""",
)
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title names a target of the site's links, beside the links of the page itself; addresses that differ by trailing
    punctuation are aliases of the plain ones."""
    read = written(extracted(table(spark, sf_dir, "pages"), "page_id").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("source"), "title", "links"), "read-links")
    href = F.regexp_extract("link.href", "^([^?#]+)", 1)
    links = read.select(F.col("source").alias("src"), F.explode("links").alias("link")).select("src", href.alias("dst")).filter("dst <> ''")
    plain = F.regexp_replace("dst", r"[^\p{L}\p{N}/]+$", "")
    aliases = links.select(F.col("dst").alias("src"), plain.alias("dst")).filter("src <> dst").distinct()
    words = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return link_gaps(read.select("source", words.alias("words")), links, aliases)
