"""Link graphs: depths, aliases, greedy leaders. Each round is one join, cut off by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def shortest_depths(links: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(node, depth) of everything that links (src, dst) reach from roots (node), by the fewest steps.

    Fixed value: pages more than `most` steps away are not reached.
    """
    seen = written(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, most + 1):
        reached = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def resolve_aliases(aliases: DataFrame, most: int = 32) -> DataFrame:
    """(src, target): where chains of (src, dst) end, by pointer doubling. A cycle ends at its smallest member.

    Every round doubles the length of the chains that are resolved, so `most` rounds suffice for 2 ** most steps.
    """
    now = written(aliases.select("src", F.col("dst").alias("target"), F.least("src", "dst").alias("low")))
    for _ in range(most):
        onward = now.select(F.col("src").alias("target"), F.col("target").alias("next"), F.col("low").alias("next_low"))
        step = now.join(onward, "target", "left").select("src", F.coalesce("next", "target").alias("target"), F.least("low", F.coalesce("next_low", "low")).alias("low"), F.col("next").isNotNull().alias("moved"))
        step = written(step)
        now = step.select("src", "target", "low")
        if step.filter("moved").join(now.select(F.col("src").alias("target")), "target", "left_semi").isEmpty():
            break
    on_cycle = now.select(F.col("src").alias("target"), F.lit(True).alias("open"))
    return now.join(on_cycle, "target", "left").select("src", F.when(F.col("open"), F.col("low")).otherwise(F.col("target")).alias("target"))


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, leader) of greedy leader clustering: nodes (node, rank) in the order of rank join the first leader that edges (a, b) connect
    them with, else they lead.

    Edges are held once, from the later node to the earlier. In a round a node without an earlier open neighbour leads, its neighbours
    follow, and edges of followers go; so edges between open nodes are all that the next round reads, until none are left. Nodes that an
    edge connects need different ranks.
    """
    c = F.col
    both = edges.select("a", "b").union(edges.select(c("b").alias("a"), c("a").alias("b"))).filter("a <> b").distinct()
    ranks = nodes.select(c("node").alias("lo"), c("rank").alias("lo_rank"))
    near = both.join(nodes.select(c("node").alias("a"), c("rank").alias("a_rank")), "a").select(c("a").alias("hi"), "a_rank", c("b").alias("lo")).join(ranks, "lo")
    near = written(near.filter(c("a_rank") >= c("lo_rank")).select("hi", "lo", "lo_rank", (c("a_rank") == c("lo_rank")).alias("tied")), "edges")
    if not near.filter("tied").isEmpty():
        raise ValueError("ranks have to differ between nodes that an edge connects")

    followers, open_ = None, near.select("hi", "lo")
    while followers is None or not open_.isEmpty():
        led = open_.join(open_.select(c("hi").alias("lo")), "lo", "left_anti")  # whose earlier node has none before it
        new = written(led.select(c("hi").alias("node")).distinct(), "followers")
        followers = new if followers is None else followers.union(new)
        open_ = written(open_.join(new.select(c("node").alias("hi")), "hi", "left_anti").join(new.select(c("node").alias("lo")), "lo", "left_anti"), "open")
    leaders = nodes.join(followers, "node", "left_anti").select("node")
    best = near.join(leaders.select(c("node").alias("lo")), "lo").groupBy(c("hi").alias("node")).agg(F.min_by("lo", "lo_rank").alias("leader"))
    # a leader has no earlier leader among its neighbours
    return nodes.join(best, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"))
