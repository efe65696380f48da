"""Text functions, structured data and ranks against plain Python."""

import random

from pyspark.sql import functions as F
from rankloom.functions import structured as S
from rankloom.functions.urls import http_url
from rankloom.functions import text as T
from rankloom.operators.ranks import ranked


def each(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_folding(spark):
    assert each(spark, T.normal_text, "  Crème  BRÛLÉE ", "l’été", "ﬁne Ａｂ", "Straße", "éa", None) == ["creme brulee", "l'ete", "fine ab", "straße", "ea", None]
    assert each(spark, T.link_text, "Tom's  «Café» – 24/7") == ["tom's cafe 24 7"]


def test_pattern_terms_and_stems(spark):
    assert each(spark, T.pattern_text, "Bob’s R&D (guide)") == ["bobs r and d guide"]
    assert each(spark, T.pattern_terms, "the best names for a cat & 2 cats 猫") == [["cat", "2", "cats", "猫"]]
    assert each(spark, T.stem, "ladies", "boxes", "houses", "cats", "bus", "class", "ties", "surnames", "begins", "x9s") == ["lady", "box", "house", "cats", "bus", "class", "ties", "name", "start", "x9s"]
    assert each(spark, T.pattern_kind, "a vs b", "10 kg is heavy", "10 kg to pounds", "top 5 cats", "Pricing of cats", "cats") == ["comparison", "general", "conversion", "curation", "pricing", "general"]


def test_title_widths(spark):
    plain = {c: w for w, chars in T.ADVANCES.items() for c in chars}

    def width(t):
        total = sum(plain.get(c, 11.1) for c in t) + sum(T.KERNING.get(t[i : i + 2], 0) for i in range(len(t) - 1))
        return int(total * 10 + 0.5 + 1e-9) / 10

    rng = random.Random(1)
    titles = ["", "AVAVA To We", *("".join(rng.choices("".join(plain).replace(" ", "").replace(" ", ""), k=40)) for _ in range(5))]
    assert each(spark, T.title_pixels, *titles) == [width(t) for t in titles]
    assert each(spark, T.title_pixels, "東京", "é", "😀", "é", "  a   b ") == [40.0, 11.1, 23.0, 11.1, round(11.1 * 2 + 5.6, 1)]


def test_counts_urls_and_hashes(spark):
    assert each(spark, T.cjk_words, "東京 tower", "one two", "", "abc漢字def") == [3, 2, 0, 4]
    assert each(spark, http_url, "HTTPS://Ex.Test:443/A?b#c", "http://ex.test", "ftp://ex.test/", "http://a b/", None) == ["https://ex.test/A?b", "http://ex.test/", None, None, None]
    assert each(spark, T.redact, "/x?api_key=1&q=2", "/x?q=2") == ["/x?api_key=[redacted]&q=2", "/x?q=2"]

    def fnv(t):
        h = 2166136261
        for c in t:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    assert each(spark, T.fnv1a, "", "a", "foobar", "é") == [fnv(t) for t in ("", "a", "foobar", "é")]
    assert each(spark, lambda t: T.mentions(t, ["Ex+ Co", "acme"]), "by ex+ co.", "acmed", "ACME!", "") == [True, False, True, False]


def test_structured_data(spark):
    html = '<script type="application/ld+json">{"@type":"Product","name":"A"}</script><SCRIPT type=\'application/ld+json\'>[{"@type":["https://schema.org/Event","X"],"name":"E","location":{"a":1},"startDate":"d"}]</SCRIPT><script type="application/ld+json">{broken</script>'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    rows = S.extract(pages, "id").select("id", "type", S.missing_properties(F.col("item"), F.col("type")).alias("m")).collect()
    assert sorted((r.id, r.type, r.m) for r in rows if r.type != "X") == [(1, "Event", []), (1, "Product", ["offers|review|aggregateRating"])]
    assert [r.m for r in rows if r.type == "X"] == [None]
    broken = pages.select("id", F.size(F.filter(S.blocks(F.col("html")), lambda b: ~S.is_json(b))).alias("n")).orderBy("id").collect()
    assert [r.n for r in broken][:2] == [1, 0]


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.random(), i) for i in range(500)] + [("hot", 1.0, i) for i in range(500, 900)]
    got = ranked(spark.createDataFrame(rows, "g string, x double, i int").repartition(7), ["g"], [F.desc("x"), F.col("i")], "place").collect()
    want = {}
    for g in ("a", "b", "hot"):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = n + 1
    assert {r.i: r.place for r in got} == want
    assert [r.place for r in ranked(spark.range(3).toDF("x"), [], [F.col("x")], "place").orderBy("x").collect()] == [1, 2, 3]


def test_pattern_coverage_reads_repeated_texts_once(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F
    from rankloom.plans.pattern_reports import ORACLE_SQL, pattern_coverage

    path, n = f"{tmp_path}/part.parquet", F.col("id")
    parts = spark.range(2000).select(n.alias("p_partkey"), F.when(n % 41 > 0, F.concat(F.lit("red box "), (n % 3).cast("string"))).alias("p_name"), F.concat(F.lit("TYPE"), (n % 2).cast("string")).alias("p_type"), F.lit("Brand#1").alias("p_brand"))
    parts.filter("p_name IS NOT NULL").coalesce(1).write.parquet(path)
    found = pattern_coverage(spark, str(tmp_path))
    assert "Aggregate" in found._jdf.queryExecution().executedPlan().toString()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{path}/*.parquet')")
        assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLE_SQL["pattern_coverage"]).fetchall())
