"""Joins with rules and of intervals against all pairs in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from rankloom.operators.intervals import meeting_totals, overlapping
from rankloom.operators.rule_joins import domains_above, longest_prefix, most_specific_property


def rows(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_longest_prefix_against_all_rules(spark):
    rng = random.Random(6)
    hosts = ["a.example", "b.example", "shop.a.example"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}" + "".join(f"/{rng.choice(['x', 'xy', 'xyz', 'p'])}" for _ in range(rng.randrange(4))) + rng.choice(["", "/", "?q=/x"])
    urls = [url() for _ in range(400)] + [None, "", "mailto:x", "https://"]
    rules = list({u[: rng.randrange(9, len(u) + 1)] for u in (url() for _ in range(120))}) + ["https://", "https://b.example", "ftp://a.example/", "no rule", None, None]
    got = {r.url: r.rule for r in longest_prefix(rows(spark, "url", urls), rows(spark, "rule", rules)).collect()}

    def origin(rule):
        scheme, _, rest = rule.partition("://")
        return f"{scheme}://" + rest.split("/")[0].split("?")[0]

    want = {}
    for u in filter(None, urls):
        # a rule holds for its own origin, or for a scheme if it has no host
        fit = [r for r in rules if r and "://" in r and u.startswith(r) and origin(r) in (origin(u), u.split("://")[0] + "://")]
        if fit:
            want[u] = max(fit, key=len)
    assert got == want


def test_a_hundred_thousand_properties_on_one_host(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("https://shop.example/u/"), F.col("id").cast("string"), F.lit("/")).alias("property"))
    rules = rules.union(rows(spark, "property", ["sc-domain:example", "sc-domain:shop.example", "https://other.example/"]))
    urls = spark.range(0, 200_000, 10).select(F.concat(F.lit("https://shop.example/u/"), F.col("id").cast("string"), F.lit("/page")).alias("url"))
    urls = urls.union(rows(spark, "url", ["https://WWW.shop.example/x", "http://a.b.example/", "https://nothing.test/", None]))
    found = most_specific_property(urls, rules)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.url: r.property for r in found.collect()}
    assert len(got) == 20_003
    assert all(got[f"https://shop.example/u/{i}/page"] == (f"https://shop.example/u/{i}/" if i < 100_000 else "sc-domain:shop.example") for i in range(0, 200_000, 10))
    assert (got["https://WWW.shop.example/x"], got["http://a.b.example/"], got["https://nothing.test/"]) == ("sc-domain:shop.example", "sc-domain:example", None)


def test_a_domain_comes_after_any_prefix(spark):
    got = {r.url: r.property for r in most_specific_property(rows(spark, "url", ["https://a.test/en/x", "https://a.test/de", "https://A.test:8080/en/x"]), rows(spark, "property", ["sc-domain:a.test", "sc-domain:a.test", "https://a.test/en/"])).collect()}
    assert got == {"https://a.test/en/x": "https://a.test/en/", "https://a.test/de": "sc-domain:a.test", "https://A.test:8080/en/x": "sc-domain:a.test"}
    assert most_specific_property(rows(spark, "url", []), rows(spark, "property", ["https://a/"])).count() == 0
    assert most_specific_property(rows(spark, "url", ["https://a/"]), rows(spark, "property", [])).collect()[0].property is None


def test_domains_above(spark):
    rules = spark.createDataFrame([("b.c", 1), ("c", 2), ("a.b.c", 3), ("x.c", 4), ("b.c", 5)], "domain string, n int")
    got = sorted((r.host, r.n) for r in domains_above(rows(spark, "host", ["a.b.c", "zb.c", "c", "", None, "c"]), rules).collect())
    assert got == [("a.b.c", 1), ("a.b.c", 2), ("a.b.c", 3), ("a.b.c", 5), ("c", 2), ("zb.c", 2)]


LEFT, RIGHT = "l long, start date, end date", "r long, begin date, until date"
NOW = dt.date(2030, 1, 1)


def intervals(rng, n):
    out = []
    for i in range(n):
        start = dt.date(1969, 1, 1) + dt.timedelta(rng.randrange(20_000))
        end = start + dt.timedelta(rng.choice([0, 1, 5, 31, 32, 33, 400, 5000, 19_000]))
        out.append((i, None if rng.random() < 0.03 else start, None if rng.random() < 0.1 else start - dt.timedelta(2) if rng.random() < 0.05 else end))
    return out


@pytest.mark.parametrize("padding", [0, 3, 100])
def test_overlaps_against_all_pairs(spark, padding):
    rng = random.Random(padding)
    left, right = intervals(rng, 200), intervals(rng, 200)
    found = overlapping(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), F.lit(NOW), padding)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wide, want = dt.timedelta(padding), []
    for a, s, e in left:
        for b, t, u in right:
            if s and t:
                e_, t_, u_ = e or NOW, t - wide, (u or NOW) + wide
                if s <= e_ and t_ <= u_ and s <= u_ and t_ <= e_:
                    want.append((a, b))
    assert sorted((r.l, r.r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("padding", [0, 3, 100])
def test_totals_of_overlaps_against_all_pairs(spark, padding):
    rng = random.Random(padding + 1)
    left, right = [*intervals(rng, 150), (900, dt.date(1, 1, 2), dt.date(9999, 1, 1)), (901, dt.date(1969, 12, 31), dt.date(1970, 1, 1))], [(i, b, u) for i, b, u in intervals(rng, 200)]
    table = spark.createDataFrame(right, RIGHT).withColumn("n", F.lit(1).cast("long"))
    found = meeting_totals(spark.createDataFrame(left + left[:5], LEFT), table, F.lit(NOW), padding, ("n",), ("r",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wide, want = dt.timedelta(padding), []
    for a, s, e in left + left[:5]:
        met = [r for r, t, u in right if s and t and s <= (e or NOW) and t - wide <= (u or NOW) + wide and s <= (u or NOW) + wide and t - wide <= (e or NOW)]
        want.append((a, len(met), min(met, default=None)))
    assert sorted((r.l, r.n, r.r) for r in found.select("l", "n", "r").collect()) == sorted(want)


def test_overlap_reports_make_no_pairs(spark, tmp_path):
    """All orders fall into all windows: a thousand by ten thousand pairs, of which no join puts out one."""
    from rankloom.plans.keyword_reports import change_confounders
    from rankloom.plans.search_reports import update_overlaps

    spark.range(1000).select((F.col("id") * 1500).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    orders = spark.range(10_000).select((F.col("id") * 7).alias("o_orderkey"), F.lit("1996-01-01").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("o_orderstatus"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for report, want in ((change_confounders, {"before": (0,), "after": (10_000,)}), (update_overlaps, {"before": (10_000, 5_000, 0), "after": (10_000, 5_000, 0)})):
        found = report(spark, str(tmp_path))
        rows = found.collect()
        assert len(rows) == 2000 and all(tuple(r)[1:] == want[r.name.split()[0]] for r in rows)
        joined, todo = [], [found._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [])
            if "Join" in node.nodeName():
                joined.append(node.metrics().apply("numOutputRows").value())
        assert joined and max(joined) < 200_000


def test_points_ties_empty_tables_and_clashing_columns(spark):
    day = dt.date(2020, 2, 29)
    left = spark.createDataFrame([(1, day, day), (1, day, day), (2, day, None)], LEFT)
    right = spark.createDataFrame([(7, day, day)], RIGHT)
    assert sorted((r.l, r.r) for r in overlapping(left, right, F.lit(NOW)).collect()) == [(1, 7), (1, 7), (2, 7)]
    assert overlapping(left.limit(0), right, F.lit(NOW)).count() == 0
    with pytest.raises(ValueError):
        overlapping(left, right.withColumn("l", F.lit(1)), F.lit(NOW))


def test_similar_queries_against_all_pairs(spark):
    import math

    from rankloom.plans.crawl_reports import similar_queries

    rng = random.Random(12)
    queries = {" ".join(rng.sample("a b c d e f g h i j k l".split(), rng.randrange(1, 6))) for _ in range(150)} | {"the " + " ".join(rng.sample("m n o p q r s t".split(), 3)) for _ in range(60)}
    sets = {q: set(q.split()) for q in queries}
    df = {}
    for terms in sets.values():
        for t in terms:
            df[t] = df.get(t, 0) + 1
    w = {t: math.log((len(sets) + 1) / (n + 1)) + 1 for t, n in df.items()}
    total = {q: sum(w[t] for t in s) for q, s in sets.items()}
    table = spark.createDataFrame([(q, t) for q, s in sets.items() for t in s], "query string, term string")
    for least in (0.3, 0.5, 0.9):
        want = {}
        for a in queries:
            for b in queries:
                if a < "f" <= b:
                    both = sum(w[t] for t in sets[a] & sets[b])
                    score = 0.5 * both / (total[a] + total[b] - both) + 0.25 * both / total[a] + 0.25 * both / total[b]
                    if score >= least:
                        want[a, b] = math.floor(score * 10000 + 0.5) / 10000
        got = {(r.target, r.source): r.score for r in similar_queries(table, F.col("query") < "f", least).collect()}
        assert got == pytest.approx(want) and want


def test_link_gaps_by_hand(spark):
    from rankloom.plans.match_reports import link_gaps

    pages = spark.createDataFrame([("/p/1", ["Blue", "blue", "shoes"]), ("/p/2", ["blue"]), ("/blue-old", ["BLUE"]), ("/p/3", None), ("/p/4", ["nothing"])], "source string, words array<string>")
    links = spark.createDataFrame([("/p/1", "/blue-old"), ("/p/9", "/blue"), ("/p/9", "/x/Shoes/"), ("/p/9", "/x/Shoes/"), ("/p/8", "/shoes"), ("/p/7", "/shoes"), ("/p/1", "/")], "src string, dst string")
    aliases = spark.createDataFrame([("/blue-old", "/blue-older"), ("/blue-older", "/blue")], "src string, dst string")
    got = sorted(tuple(r) for r in link_gaps(pages, links, aliases).collect())
    assert got == [("/blue", "/blue", "self-alias", 2), ("/p/1", "/blue", "existing-link", 2), ("/p/1", "/shoes", "missing", 2), ("/p/2", "/blue", "missing", 2)]
    assert link_gaps(pages, links.limit(0), aliases).count() == 0
