"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

A key hashes to an arc of the ring, which belongs to the virtual node at its clockwise end. Arcs hand their keys to the shard that owns
them until it is full; what doesn't fit continues clockwise to the next shard with room. Only the loads of the arcs, a table of fixed
size, are needed to know where every shard fills up; keys then find their shard by their rank on their arc.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialize

#: Places on the ring: a table of this size leads from a key's hash to its arc.
RING = 1 << 14
#: Rows that one task numbers; the ring's order is cut into ranges of about so many.
ROWS_PER_PART = 200_000


def ring(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. A node's position depends on its shard and number alone."""
    nodes = {}
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            at = zlib.crc32(f"shard-{shard}-node-{node}".encode()) % RING
            while at in nodes:
                at = (at + 1) % RING
            nodes[at] = shard
    return sorted(nodes.items())


def walk(loads: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from rank, to rank, shard, first slot): ranks of each arc by the shard that takes them.

    loads: keys on each arc. All owners are served first, in clockwise order; then each arc's overflow moves on clockwise.
    """
    room, used, over, pieces = list(capacity), [0] * len(capacity), [], []

    def give(arc: int, start: int, n: int, shard: int) -> int:
        took = min(n, room[shard])
        if took:
            pieces.append((arc, start, start + took, shard, used[shard]))
            room[shard] -= took
            used[shard] += took
        return took

    for arc, owner in enumerate(owners):
        if n := loads.get(arc, 0):
            took = give(arc, 0, n, owner)
            if took < n:
                over.append((arc, took, n - took))
    for arc, start, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            took = give(arc, start, n, owners[at])
            start, n = start + took, n - took
    return pieces


def bounded_load_shards(docs: DataFrame, n_shards: int = 8, virtual_nodes: int = 128, id_col: str = "doc_id", text_col: str = "text", load_factor: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in each shard).

    A shard takes at most load_factor times its even share of the rows; at 1.0, counts are at most one apart. Null texts have size 1
    and the checksum of no bytes. Null and repeated ids share a place on the ring; however many there are, their rows overflow like any
    others. Rows of an arc are ranked by the hash of their key, then by id, checksum and size: rows that tie are the same, so the order
    of the input doesn't matter. An empty table gives no rows; other columns are ignored.
    """
    if load_factor < 1:
        raise ValueError("shards that take less than their even share can't hold all rows")
    spark = docs.sparkSession
    nodes = ring(n_shards, virtual_nodes)
    positions, owners = [p for p, _ in nodes], [s for _, s in nodes]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key_hash = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        key_hash.alias("key_hash"),
        F.pmod(key_hash, F.lit(RING)).cast("int").alias("place"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    # the node at or after a place takes it; past the last, the first does
    arc_of = spark.createDataFrame([(p, bisect_left(positions, p) % len(positions)) for p in range(RING)], "place int, arc int")
    keyed = materialize(keyed.join(F.broadcast(arc_of), "place"), "ring-places")

    arcs = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # a row for each virtual node at most
    total = sum(arcs.values())
    even, left = divmod(total, n_shards)
    capacity = [int(load_factor * (even + (s < left))) if load_factor > 1 else even + (s < left) for s in range(n_shards)]
    pieces = spark.createDataFrame(walk(arcs, owners, capacity), "arc int, lo long, hi long, shard int, first_slot long")

    # ranges of the ring's order, cut by Spark where the rows are: row_no splits rows that tie
    order = ["key_hash", "doc_id", "text_crc32", "size"]
    ranges = keyed.repartitionByRange(-(-total // ROWS_PER_PART) or 1, "arc", *order, "row_no")
    rows = materialize(ranges.select("arc", *order, F.spark_partition_id().alias("part")), "ring-order")
    counts = rows.groupBy("arc", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("arc", "part", "offset")
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("arc", "part").orderBy(*order)))
    ranked = numbered.join(offsets, ["arc", "part"]).withColumn("rank", F.col("offset") + F.col("nth") - 1).alias("r")
    piece = F.broadcast(pieces).alias("p")  # two or so for each virtual node
    placed = ranked.join(piece, (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"))
