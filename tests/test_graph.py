import random

import pytest
from rankloom.operators import graph
from rankloom.operators.graph import greedy_leaders, resolve_aliases, shortest_depths


def test_depths_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "src string, dst string")
    rows = shortest_depths(links, spark.createDataFrame([("a",)], "node string")).collect()
    assert {r.node: r.depth for r in rows} == {"a": 0, "b": 1, "c": 1}


def test_aliases_end_chains_and_cycles(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("p", "x")], "src string, dst string")
    got = {r.src: r.target for r in resolve_aliases(hops).collect()}
    assert {k: got[k] for k in "abc"} == {"a": "d", "b": "d", "c": "d"}
    assert {got[k] for k in "xyzp"} <= set("xyzp")


def test_greedy_leaders_match_the_sequential_rule(spark):
    rng = random.Random(9)
    nodes = [f"n{i:02d}" for i in range(30)]
    edges = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(45)}
    near = {n: {b for e in edges for b in e if n in e and b != n} for n in nodes}
    leaders, want = [], {}
    for n in nodes:
        first = next((x for x in leaders if x in near[n]), None)
        want[n] = first or n
        if first is None:
            leaders.append(n)
    got = greedy_leaders(spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "node string, rank int"), spark.createDataFrame(sorted(edges), "a string, b string"))
    assert {r.node: r.leader for r in got.collect()} == want


def test_greedy_leaders_settle_a_long_chain(spark, monkeypatch):
    """Two nodes a round: a chain of 140 takes 70 rounds. Rounds are kept in memory here."""
    monkeypatch.setattr(graph, "written", lambda df, name="": df.sparkSession.createDataFrame(df.toArrow(), df.schema))
    nodes = spark.createDataFrame([(i, i) for i in range(140)], "node long, rank int").coalesce(1)
    got = greedy_leaders(nodes, spark.createDataFrame([(i, i + 1) for i in range(139)], "a long, b long").coalesce(1))
    assert {r.node: r.leader for r in got.collect()} == {i: i - i % 2 for i in range(140)}


def test_ranks_that_tie_are_refused(spark):
    with pytest.raises(ValueError):
        greedy_leaders(spark.createDataFrame([(1, 5), (2, 5)], "node long, rank int"), spark.createDataFrame([(1, 2)], "a long, b long"))


def test_nodes_without_edges_lead(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "node long, rank int")
    none = spark.createDataFrame([], "a long, b long")
    assert {r.node: r.leader for r in greedy_leaders(nodes, none).collect()} == {1: 1, 2: 2, 3: 3}
    loops = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (3, 1)], "a long, b long")
    assert {r.node: r.leader for r in greedy_leaders(nodes, loops).collect()} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("n_edges", [10, 60, 300])
def test_greedy_leaders_of_random_graphs(spark, n_edges):
    rng = random.Random(n_edges)
    order = rng.sample(range(60), 60)
    edges = {tuple(rng.sample(range(60), 2)) for _ in range(n_edges)}
    near = {n: {b for e in edges for b in e if n in e and b != n} for n in order}
    leaders, want = [], {}
    for n in order:
        want[n] = next((x for x in leaders if x in near[n]), n)
        if want[n] == n:
            leaders.append(n)
    got = greedy_leaders(spark.createDataFrame([(n, i) for i, n in enumerate(order)], "node long, rank int"), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {r.node: r.leader for r in got.collect()} == want
