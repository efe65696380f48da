"""Candidates by their numbers against nested loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from rankloom.operators.candidates import PatternSet, digits, generate, in_turns, pair_of, path_of, reviewed

LIST = "set_id string, axis string, value_id string, label string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 60])
def test_all_pairs_in_order(spark, n):
    i, j = pair_of(F.col("id"), n)
    got = [tuple(r) for r in spark.range(0, n * (n - 1) // 2, 1, 1).select(i, j).collect()]
    assert got == list(itertools.combinations(range(n), 2))


def test_pairs_of_three_thousand_million_values(spark):
    m, rng = 3_000_000_000, random.Random(4)
    pairs = [(0, 1), (0, m - 1), (1, 2), (m - 2, m - 1), (m - 3, m - 1)] + [tuple(sorted(rng.sample(range(m), 2))) for _ in range(500)] + [(a, a + 1) for a in range(m - 200, m - 1)]
    numbers = [(a * (2 * m - a - 1) // 2 + b - a - 1,) for a, b in pairs]
    i, j = pair_of(F.col("n"), m)
    assert [tuple(r) for r in spark.createDataFrame(numbers, "n long").select(i, j).collect()] == pairs


def test_digits_of_any_radix(spark):
    got = [tuple(r) for r in spark.range(0, 60, 1, 1).select(*digits(F.col("id"), [3, 4, 5])).collect()]
    assert got == list(itertools.product(range(3), range(4), range(5)))


def test_turns():
    for totals, limit in (([5, 1, 9], 7), ([5, 1, 9], 0), ([5, 1, 9], 15), ([5, 1, 9], 99), ([0, 3], 2), ([4, 4, 4], 7)):
        left, want = list(totals), [0] * len(totals)
        while sum(want) < limit and any(left):
            for i in range(len(totals)):
                if left[i] and sum(want) < limit:
                    left[i], want[i] = left[i] - 1, want[i] + 1
        assert in_turns(totals, limit) == want
    assert in_turns([5, 1], None) == [5, 1]


def values(spark, **lists):
    """lists: <set>__<axis> to ids."""
    return spark.createDataFrame([(*k.split("__"), v, f"{v} label") for k, ids in lists.items() for v in ids], LIST)


def test_a_matrix_of_three_lists(spark):
    lists = values(spark, m__b=["b2", "b1"], m__a=["a1", "a2", "a3"], m__c=["c1"], other__a=["zzz"])
    s = PatternSet("m", "directory", "matrix", ("{a} in  {b}{x}", "{c}", "{c}"), "/{b}//{a}/", axes=("b", "a", "c"))
    made, summary = generate([s], lists)
    rows = sorted(made.collect(), key=lambda r: r.number)
    want = list(itertools.product(["b1", "b2"], ["a1", "a2", "a3"], ["c1"]))
    assert [r.candidate for r in rows] == [f"m:a={a},b={b},c={c}" for b, a, c in want]
    assert [r.path for r in rows] == [f"/{b}/{a}" for b, a, _ in want]
    assert rows[0].queries == ["a1 label in b1 label", "c1 label"]
    assert tuple(summary.first()) == ("m", 6, 6, 0, 18)


def test_pairs_of_all_kinds_and_limits(spark):
    lists = values(spark, p__value=["c", "a", "b"], k__value=["c", "a", "b"], e__value=["c", "a", "b"], gone__value=["x"])
    sets = [
        PatternSet("p", "comparison", "pairs", ("{left} vs {right}",), "/{left}-vs-{right}"),
        PatternSet("k", "alternatives", "pairs", (), "/{left}-or-{right}", pairing="anchor", anchor="b"),
        PatternSet("e", "comparison", "pairs", ("{left}",), None, pairing="explicit"),
        PatternSet("gone", "general", "pairs", ("{left}",), pairing="anchor", anchor="unknown"),
        PatternSet("none", "general", "terms", ("{value}",)),
    ]
    pairs = spark.createDataFrame([("e", 5, "c", "a"), ("e", 1, "b", "b"), ("e", 2, "a", "zz"), ("q", 1, "a", "b")], "set_id string, ord long, left_id string, right_id string")
    made, summary = generate(sets, lists, pairs)
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.set_id, r.number)):
        got.setdefault(r.set_id, []).append((r.candidate.split(":")[1], r.path, r.inventory_paths))
    assert got["p"] == [(f"left={a},right={b}", f"/{a}-vs-{b}", sorted([f"/{a}-vs-{b}", f"/{b}-vs-{a}"])) for a, b in itertools.combinations("abc", 2)]
    assert got["k"] == [("left=b,right=a", "/b-or-a", ["/b-or-a"]), ("left=b,right=c", "/b-or-c", ["/b-or-c"])]
    assert got["e"] == [("left=b,right=b", None, []), ("left=c,right=a", None, [])]
    assert set(got) == {"p", "k", "e"}
    assert {r.set_id: tuple(r)[1:] for r in summary.collect()} == {"p": (3, 3, 0, 3), "k": (2, 2, 0, 0), "e": (3, 2, 1, 3), "gone": (0, 0, 0, 0), "none": (0, 0, 0, 0)}
    made, summary = generate(sets, lists, pairs, limit=4)
    assert sorted(r.candidate for r in made.collect()) == ["e:left=b,right=b", "k:left=b,right=a", "p:left=a,right=b", "p:left=a,right=c"]


def test_a_million_candidates(spark):
    lists = spark.range(100).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("axis"), F.format_string("%02d", "id").alias("value_id"))
    lists = lists.select(F.lit("big").alias("set_id"), "axis", "value_id", F.col("value_id").alias("label"))
    made, summary = generate([PatternSet("big", "general", "matrix", ("{a} {b} {c}",), "/{a}/{b}/{c}", axes=("a", "b", "c"))], lists)
    assert "CartesianProduct" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    row = made.agg(F.count("*").alias("n"), F.countDistinct("candidate").alias("d"), F.count_if(F.col("number") == F.replace(F.substring("path", 2, 8), F.lit("/"), F.lit("")).cast("long")).alias("right")).first()
    assert tuple(row) == (1_000_000, 1_000_000, 1_000_000) and summary.first().planned == 1_000_000


def test_paths(spark):
    row = spark.range(1).select(*[path_of(p, {"a": F.lit("x y"), "b": F.lit("")}) for p in ("/{b}/", "//{a}//{b}", "{a}", "/{b}", "")]).first()
    assert list(row) == ["/", "/x y", "x y", "/", "/"]


def test_reviews_by_hand(spark):
    lists = values(spark, s__value=["a", "b", "c", "d"], t__value=["a", "b"], u__value=["a"])
    sets = [PatternSet("s", "glossary", "terms", ("{value}", "{value}!"), "/{value}"), PatternSet("t", "glossary", "terms", ("nothing",), "/none/{value}", "complete-set"), PatternSet("u", "glossary", "terms", ("{value}",))]
    rows = spark.createDataFrame([("A label", "https://x/a/", 1, 10, 2.0), ("b label", "https://x/other", 0, 0, 4.0), ("d label", "https://x/e", 2, 5, 3.0)], "query string, page string, clicks long, impressions long, position double")
    urls = spark.createDataFrame([("https://x/a",), ("https://x/b/",), ("https://x/c",), ("https://y/c/?q=1",), (None,)], "url string")
    made, _ = generate(sets, lists)
    key = lambda c: F.lower(F.regexp_replace(c, "!", ""))
    got = {r.candidate: (r.n_matched, r.clicks, r.impressions, r.position, r.n_pages, r.n_urls, r.review) for r in reviewed(made, rows, urls, key).collect()}
    assert got == {
        "s:value=a": (2, 2, 20, 2.0, 1, 1, "existing-topic"), "s:value=b": (2, 0, 0, 0.0, 1, 1, "possible-overlap"), "s:value=c": (0, 0, 0, 0.0, 0, 2, "possible-overlap"),
        "s:value=d": (2, 4, 10, 3.0, 1, 0, "search-evidenced-gap"), "t:value=a": (0, 0, 0, 0.0, 0, 0, "strategic-gap"), "t:value=b": (0, 0, 0, 0.0, 0, 0, "strategic-gap"),
        "u:value=a": (1, 1, 10, 2.0, 1, 0, "inventory-unknown"),
    }
