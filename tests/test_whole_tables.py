"""Reports whose SQL reads a part of the rows, against plain Python over whole small tables."""

import random
from collections import defaultdict

from rankloom.plans import catalog


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_fanout_and_conflicts_read_all_lines(spark, tmp_path):
    rng = random.Random(3)
    words = ["red", "blue", "old", "new", "tin"]
    parts = [(i, " ".join(rng.sample(words, 2))) for i in range(8)] + [(8, "rare tin")]
    lines = [(o, rng.randrange(8), n, "AN"[n > 1 and o % 2]) for o in range(1, 60) for n in range(1, 4)] + [(61, 8, 1, "A"), (62, 8, 1, "A")]
    put(spark, tmp_path, "part", parts, "p_partkey long, p_name string")
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")
    seen, flags = defaultdict(set), defaultdict(list)
    for order, part, _, flag in lines:
        flags[order % 1000].append(flag)
        for term in dict(parts)[part].split():
            seen[term].add(order)
    got = {r.term: r.n for r in catalog.QUERIES["fanout_themes"](spark, str(tmp_path)).collect()}
    assert got == {t: len(o) for t, o in seen.items() if len(o) >= 2} and got["rare"] == 2
    kept = {(r.k, r.v, r.n) for r in catalog.QUERIES["dedupe_conflicts"](spark, str(tmp_path)).collect()}
    assert kept == {(k, v[0], len(v)) for k, v in flags.items() if len(set(v)) == 1}


def test_graphs_take_all_parts_and_pages(spark, tmp_path):
    size = 1200
    put(spark, tmp_path, "part", [(i,) for i in range(size)], "p_partkey long")
    put(spark, tmp_path, "pages", [(i, '<a href="/de">x</a>' + '<a href="/en">y</a>' * (i % 2)) for i in range(120)], "page_id long, html string")
    depth, queue = {0: 0}, [0]
    for node in queue:
        for to in ((node * 7 + 3) % size, (node * 2 + 1) % size):
            if to not in depth:
                depth[to] = depth[node] + 1
                queue.append(to)
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.node: r.depth for r in run("crawl_depth")} == depth
    assert {r.src: r.target for r in run("alias_resolve")} == {i: i % 8 for i in range(8, size)}
    assert {(r.dst, r.n_inlinks, r.authority) for r in run("inlink_authority")} == {("/de", 120, 100), ("/en", 60, 50)}
