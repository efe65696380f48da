"""Candidates of page patterns, made from value lists and held against the queries and URLs that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pattern_text
from ..operators.candidates import PatternSet, generate, reviewed
from ..sources.views import QUERY_PAGE, query_page_table, search_rows, table

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


#: {unknown}, and {tool} of the shops, are no lists of their sets: nothing stands for them.
SETS = [
    PatternSet("names", "general", "matrix", ("{age} {tool}", "best {age}  {tool}", "{age} {tool}{unknown}"), axes=("age", "tool")),
    PatternSet("shops", "directory", "matrix", ("{type} {tool} from supplier {supplier}",), "//{type}/supplier-{supplier}/", "complete-set", ("type", "supplier")),
    PatternSet("versus", "comparison", "pairs", ("{left} vs {right}", "{right} vs {left}"), "/compare/{left}-vs-{right}"),
    PatternSet("anchored", "alternatives", "pairs", ("{left} or {right}",), "/compare/{left}-vs-{right}", pairing="anchor", anchor="bolt"),
    PatternSet("listed", "comparison", "pairs", ("{left} and {right}",), "/compare/{left}-vs-{right}", "complete-set", pairing="explicit"),
    PatternSet("tools", "glossary", "terms", ("{value}", "old {value}"), "/{value}"),
]


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values and explicit pairs of SETS, from the names of the parts."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    lists = [("names", "age", word(1)), ("names", "tool", word(2)), ("shops", "type", F.lower("p_type")), *((s, "value", word(2)) for s in ("versus", "anchored", "listed", "tools"))]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("set_id"), F.lit(a).alias("axis"), v.alias("value_id")) for s, a, v in lists]))
    values = p.select(each.alias("v")).select("v.*").distinct().withColumn("label", F.col("value_id"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("shops").alias("set_id"), F.lit("supplier").alias("axis"), (F.col("s_suppkey") % 13).cast("string").alias("value_id"))
    values = values.union(suppliers.distinct().withColumn("label", F.concat(F.lit("no "), "value_id")))
    pairs = p.select(F.lit("listed").alias("set_id"), F.col("p_partkey").cast("long").alias("ord"), word(2).alias("left_id"), F.when(F.col("p_partkey") % 9 == 0, "unknown").otherwise(word(1)).alias("right_id"))
    values = values.union(p.select(F.lit("listed"), F.lit("value"), word(1), F.concat(word(1), F.lit(" things"))).distinct())
    return values, pairs


_VALUES = """
lists(set_id, axis, value_id, label) AS (
  SELECT DISTINCT 'names', 'age', split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM part UNION SELECT 'names', 'tool', split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part
  UNION SELECT 'shops', 'type', lower(p_type), lower(p_type) FROM part UNION SELECT 'shops', 'supplier', CAST(s_suppkey % 13 AS VARCHAR), concat('no ', s_suppkey % 13) FROM supplier
  UNION SELECT s, 'value', split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part, (VALUES ('versus'), ('anchored'), ('listed'), ('tools')) AS t(s)
  UNION SELECT 'listed', 'value', split_part(p_name, ' ', 1), concat(split_part(p_name, ' ', 1), ' things') FROM part),
vals AS (SELECT *, row_number() OVER (PARTITION BY set_id, axis ORDER BY value_id) - 1 AS no, count(*) OVER (PARTITION BY set_id, axis) AS size FROM lists),
named AS (SELECT 'listed' AS set_id, p_partkey AS ord, split_part(p_name, ' ', 2) AS l, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE split_part(p_name, ' ', 1) END AS r FROM part),
made AS (
  SELECT 'names' AS set_id, concat('names:age=', a.value_id, ',tool=', t.value_id) AS candidate, a.no * t.size + t.no AS number, 'evidence-led' AS policy, NULL AS path, []::VARCHAR[] AS paths,
    [concat(a.label, ' ', t.label), concat('best ', a.label, ' ', t.label)] AS queries
  FROM vals a, vals t WHERE a.set_id = 'names' AND a.axis = 'age' AND t.set_id = 'names' AND t.axis = 'tool'
  UNION ALL SELECT 'shops', concat('shops:supplier=', s.value_id, ',type=', t.value_id), t.no * s.size + s.no, 'complete-set', concat('/', t.value_id, '/supplier-', s.value_id), [concat('/', t.value_id, '/supplier-', s.value_id)],
    [concat(t.label, ' from supplier ', s.label)]
  FROM vals t, vals s WHERE t.set_id = 'shops' AND t.axis = 'type' AND s.set_id = 'shops' AND s.axis = 'supplier'
  UNION ALL SELECT 'versus', concat('versus:left=', l.value_id, ',right=', r.value_id), row_number() OVER (ORDER BY l.no, r.no) - 1, 'evidence-led', concat('/compare/', l.value_id, '-vs-', r.value_id),
    [concat('/compare/', l.value_id, '-vs-', r.value_id), concat('/compare/', r.value_id, '-vs-', l.value_id)], [concat(l.label, ' vs ', r.label), concat(r.label, ' vs ', l.label)]
  FROM vals l JOIN vals r ON l.set_id = 'versus' AND r.set_id = 'versus' AND l.no < r.no
  UNION ALL SELECT 'anchored', concat('anchored:left=', l.value_id, ',right=', r.value_id), row_number() OVER (ORDER BY r.no) - 1, 'evidence-led', concat('/compare/', l.value_id, '-vs-', r.value_id), [concat('/compare/', l.value_id, '-vs-', r.value_id)],
    [concat(l.label, ' or ', r.label)]
  FROM vals l JOIN vals r ON l.set_id = 'anchored' AND r.set_id = 'anchored' AND l.value_id = 'bolt' AND r.value_id <> 'bolt'
  UNION ALL SELECT 'listed', concat('listed:left=', l.value_id, ',right=', r.value_id), row_number() OVER (ORDER BY ord) - 1, 'complete-set', concat('/compare/', l.value_id, '-vs-', r.value_id),
    list_distinct([concat('/compare/', l.value_id, '-vs-', r.value_id), concat('/compare/', r.value_id, '-vs-', l.value_id)]), [concat(l.label, ' and ', r.label)]
  FROM named n JOIN vals l ON l.set_id = 'listed' AND l.value_id = n.l JOIN vals r ON r.set_id = 'listed' AND r.value_id = n.r
  UNION ALL SELECT 'tools', concat('tools:value=', value_id), no, 'evidence-led', concat('/', value_id), [concat('/', value_id)], [label, concat('old ', label)] FROM vals WHERE set_id = 'tools')"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were searched, and comparisons of what follows each other among the parts."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    a, b = p.select((F.col("p_partkey") + 3).alias("k"), word(2).alias("x")), p.select(F.col("p_partkey").alias("k"), word(2).alias("y"), "p_size")
    compared = a.join(b, "k").filter("p_size < 4 OR p_size = 30").select(F.concat(F.lit("https://shop.example/compare/"), "x", F.lit("-vs-"), "y", F.when(F.col("p_size") == 1, "/").otherwise("")).alias("url"))
    return search_rows(spark, sf_dir).select(F.col("page").alias("url")).union(compared).distinct()


@report(
    "pattern_candidates",
    f"""WITH {QUERY_PAGE}, {_VALUES}, demand AS (SELECT query, sum(impressions)::BIGINT AS impressions FROM query_page GROUP BY 1)
    SELECT replace(m.queries[1], ' ', ' for ') AS candidate, d.query IS NOT NULL AS retained, coalesce(d.impressions, 0) AS impressions FROM made m LEFT JOIN demand d ON d.query = m.queries[1] WHERE set_id = 'names'""",
)
def pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled with two lists of values, beside the queries that exist."""
    made, _ = generate([PatternSet("names", "general", "matrix", ("{age} {tool}",), axes=("age", "tool"))], _lists(spark, sf_dir)[0])
    d = search_rows(spark, sf_dir).groupBy(F.col("query").alias("q")).agg(F.sum("impressions").alias("impressions"))
    rows = made.withColumn("query", F.element_at("queries", 1)).join(d, F.col("q") == F.col("query"), "left")
    return rows.select(F.replace("query", F.lit(" "), F.lit(" for ")).alias("candidate"), F.col("q").isNotNull().alias("retained"), F.coalesce("impressions", F.lit(0)).alias("impressions"))


@report("candidate_lists", f"WITH {_VALUES} SELECT set_id, candidate, number, policy, path, list_sort(paths) AS inventory_paths, list_sort(queries) AS queries FROM made")
def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all sets: matrices, pairs of all kinds and terms, with their paths and queries."""
    made, _ = generate(SETS, *_lists(spark, sf_dir))
    return made.select("set_id", "candidate", "number", "policy", "path", "inventory_paths", "queries")


_LIMIT = 60
_REVIEWED = f"""{QUERY_PAGE}, {_VALUES},
keyed AS (SELECT trim(regexp_replace(replace(lower(query), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key, page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(position * impressions) AS weighted FROM query_page GROUP BY 1, 2),
demand AS (SELECT key, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(weighted) AS weighted FROM keyed GROUP BY 1),
urls AS (SELECT DISTINCT page AS url FROM query_page UNION SELECT concat('https://shop.example/compare/', split_part(a.p_name, ' ', 2), '-vs-', split_part(b.p_name, ' ', 2), CASE WHEN b.p_size = 1 THEN '/' ELSE '' END)
  FROM part a JOIN part b ON a.p_partkey + 3 = b.p_partkey WHERE b.p_size < 4 OR b.p_size = 30),
placed AS (SELECT url, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM urls),
c AS (SELECT set_id, candidate, min(number) AS number, any_value(policy) AS policy, any_value(path) AS path, any_value(paths) AS paths, any_value(queries) AS queries FROM made GROUP BY 1, 2),
asked AS (SELECT DISTINCT candidate, unnest(queries) AS query FROM c),
matched AS (SELECT candidate, count(*) AS n_matched, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(weighted) AS weighted FROM asked JOIN demand ON key = query GROUP BY 1),
seen AS (SELECT DISTINCT candidate, page, regexp_replace(regexp_extract(page, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM asked JOIN keyed ON key = query),
mine AS (SELECT DISTINCT candidate, unnest(paths) AS path FROM c),
found AS (SELECT candidate, count(*) AS n_urls FROM mine JOIN placed USING (path) GROUP BY 1),
own AS (SELECT DISTINCT candidate FROM seen JOIN mine USING (candidate, path)),
reviewed AS (SELECT set_id, c.candidate, number, policy, c.path, len(queries) AS n_queries, coalesce(n_matched, 0) AS n_matched, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions,
  coalesce(weighted / impressions, 0) AS position, (SELECT count(*) FROM seen WHERE seen.candidate = c.candidate) AS n_pages, coalesce(n_urls, 0) AS n_urls,
  CASE WHEN n_urls > 1 OR n_urls = 1 AND n_matched > 0 AND own.candidate IS NULL THEN 'possible-overlap' WHEN n_urls = 1 THEN 'existing-topic' WHEN c.path IS NULL THEN 'inventory-unknown' WHEN policy = 'complete-set' THEN 'strategic-gap'
    WHEN n_matched > 0 THEN 'search-evidenced-gap' ELSE 'research-only' END AS review
  FROM c LEFT JOIN matched USING (candidate) LEFT JOIN found USING (candidate) LEFT JOIN own USING (candidate))"""


@report("candidate_reviews", f"WITH {_REVIEWED} SELECT set_id, candidate, path, n_queries, n_matched, clicks, impressions, position, n_pages, n_urls, review FROM reviewed")
def candidate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their demand, the pages that there are, and whether a page is missing."""
    made, _ = generate(SETS, *_lists(spark, sf_dir))
    return reviewed(made, query_page_table(spark, sf_dir), _urls(spark, sf_dir), pattern_text)


@report(
    "candidate_sets",
    f"""WITH {_REVIEWED}, m AS (SELECT set_id, number, candidate FROM made), turns AS (SELECT *, row_number() OVER (ORDER BY number, list_position(['names', 'shops', 'versus', 'anchored', 'tools'], set_id)) AS turn FROM m WHERE set_id <> 'listed'),
    kept AS (SELECT set_id, candidate FROM turns WHERE turn <= {_LIMIT}),
    p AS (SELECT set_id, count(*) AS planned, CASE set_id WHEN 'names' THEN 3 WHEN 'shops' THEN 1 WHEN 'anchored' THEN 1 ELSE 2 END AS per FROM m WHERE set_id <> 'listed' GROUP BY 1)
    SELECT p.set_id, p.planned, count(k.candidate) AS returned, p.planned - count(k.candidate) AS omitted, p.planned * p.per AS planned_variants, coalesce(sum(r.n_queries), 0)::BIGINT AS returned_variants,
      count(*) FILTER (WHERE r.n_urls > 0) AS existing, count(*) FILTER (WHERE r.review = 'strategic-gap') AS strategic_gaps, count(*) FILTER (WHERE r.review = 'search-evidenced-gap') AS evidenced_gaps
    FROM p LEFT JOIN kept k ON k.set_id = p.set_id LEFT JOIN reviewed r ON r.candidate = k.candidate GROUP BY p.set_id, p.planned, p.per""",
)
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set's planned candidates and what it gives when all sets together give _LIMIT of them by turns."""
    sets = [s for s in SETS if s.id != "listed"]
    made, summary = generate(sets, _lists(spark, sf_dir)[0], None, _LIMIT)
    r = reviewed(made, query_page_table(spark, sf_dir), _urls(spark, sf_dir), pattern_text)
    found = r.groupBy("set_id").agg(
        F.sum("n_queries").cast("long").alias("returned_variants"), F.count_if(F.col("n_urls") > 0).alias("existing"), F.count_if(F.col("review") == "strategic-gap").alias("strategic_gaps"),
        F.count_if(F.col("review") == "search-evidenced-gap").alias("evidenced_gaps"),
    )
    return summary.join(found, "set_id", "left").fillna(0)
