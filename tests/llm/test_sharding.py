import zlib
from collections import Counter

from pyspark.sql import functions as F

from rankloom.llm.sharding import bounded_load_shards, ring, walk


def check(rows, n):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts.get(s, 0)))


def test_even_counts_and_gapless_slots(spark):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("shard"))
    rows = bounded_load_shards(docs).collect()
    check(rows, 8)
    for r in rows[:50]:
        data = f"é {r.doc_id}".encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_one_hot_key_overflows(spark, monkeypatch):
    monkeypatch.setattr("rankloom.llm.sharding.ROWS_PER_PART", 50)
    docs = spark.createDataFrame([(7, "same")] * 300 + [(None, None)] * 200 + [(i, "t") for i in range(101)], "doc_id long, text string")
    rows = bounded_load_shards(docs).collect()
    assert len(rows) == 601
    check(rows, 8)
    assert {r.size for r in rows if r.doc_id is None} == {1}


def test_empty_and_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    check(bounded_load_shards(docs).collect(), 8)
    assert bounded_load_shards(docs.limit(0)).count() == 0


def test_few_keys_move_when_a_shard_is_added(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = bounded_load_shards(docs, 8).select("doc_id", F.col("shard").alias("a")), bounded_load_shards(docs, 9).select("doc_id", F.col("shard").alias("b"))
    moved = a.join(b, "doc_id").filter("a <> b").count() / 20000
    assert moved < 0.35  # a ninth has to move; overflow adds some


def test_walk_gives_every_key_one_shard():
    owners = [s for _, s in ring(3, 4)]
    pieces = walk({0: 50, 5: 1, 11: 3}, owners, [18, 18, 18])
    assert sum(hi - lo for _, lo, hi, _, _ in pieces) == 54
    for arc, n in ((0, 50), (5, 1), (11, 3)):
        assert sorted(x for a, lo, hi, _, _ in pieces if a == arc for x in range(lo, hi)) == list(range(n))
