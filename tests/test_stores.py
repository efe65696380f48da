"""Running sums and places against sorted lists; stores written twice, deleted from and compacted."""

import random

import pytest
from pyspark.sql import functions as F
from rankloom.operators.ranks import ranked, running, running_sum
from rankloom.operators.samples import first_rows
from rankloom.operators.tables import shared_dir
from rankloom.sources.stores import SnapshotStore


def test_running_sums_and_places_of_few_and_many_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, -5, 10**12])) for i in rng.sample(range(5000), 1500)]
    table = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    for by in ([], ["g"]):
        got = {r.i: (r.place, r.total) for r in running(table, by, [F.desc("i")], "place", {"total": F.col("v")}).collect()}
        seen = {}
        for g, i, v in sorted(rows, key=lambda r: -r[1]):
            n, total = seen.get(g if by else 0, (0, None))
            seen[g if by else 0] = now = (n + 1, total if v is None else (total or 0) + v)
            assert got[i] == now
    assert {r.i: r.n for r in ranked(table, [], [F.col("i")], "n").collect()} == {i: k + 1 for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: r[1]))}
    assert running_sum(table.limit(0), ["g"], [F.col("i")], F.col("v"), "s").count() == 0


def test_first_rows_of_a_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 == 1, "small").when(F.col("id") % 100 == 2, F.lit(None)).otherwise("hot").alias("g"), "id")
    got = sorted((r.g or "", r.n, r.id) for r in first_rows(rows, ["g"], [F.desc("id")], 3, "n").collect())
    assert got == [("", 1, 19_902), ("", 2, 19_802), ("", 3, 19_702), ("hot", 1, 19_999), ("hot", 2, 19_998), ("hot", 3, 19_997), ("small", 1, 19_901), ("small", 2, 19_801), ("small", 3, 19_701)]


SCHEMA = "k string, at long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), SCHEMA, ["k"])


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_a_run_written_twice_is_there_once(spark, store):
    store.append("r1", table(spark, ("a", 1, "x"), ("b", 1, "y"), (None, 1, "n")))
    store.append("r2", table(spark, ("a", 2, "wrong"), ("c", 2, "wrong")))
    store.append("r2", table(spark, ("a", 2, "z")))
    assert read(store.rows()) == [("a", 1, "x", "r1"), ("a", 2, "z", "r2"), ("b", 1, "y", "r1"), (None, 1, "n", "r1")]
    assert read(store.latest("at")) == [("a", 2, "z"), ("b", 1, "y"), (None, 1, "n")]


def test_a_later_run_wins_among_equals(spark, store):
    store.append("r2", table(spark, ("a", 1, "later run")))
    store.append("r1", table(spark, ("a", 1, "x")))
    assert read(store.latest("at")) == [("a", 1, "later run")]
    assert read(store.latest()) == [("a", 1, "later run")]


def test_deletes_concern_earlier_runs(spark, store):
    store.append("r1", table(spark, ("a", 1, "x"), ("b", 1, "y"), (None, 1, "n")))
    for _ in range(2):
        store.delete("r2", spark.createDataFrame([("a",), (None,), ("a",), ("unknown",)], "k string"))
    store.append("r3", table(spark, ("a", 3, "again")))
    assert read(store.rows()) == [("a", 3, "again", "r3"), ("b", 1, "y", "r1")]


def test_compaction_keeps_the_newest_and_the_newest_that_succeeded(spark, store):
    store.append("r1", table(spark, ("a", 1, "ok"), ("a", 2, None), ("b", 1, "ok")))
    store.append("r2", table(spark, ("a", 3, None), ("a", 4, None), ("b", 2, "ok")))
    store.delete("r3", spark.createDataFrame([("c",)], "k string"))
    store.retain([F.desc("at")], 1, F.col("v").isNotNull())
    want = [("a", 1, "ok", "r1"), ("a", 4, None, "r2"), ("b", 2, "ok", "r2")]
    assert store.generation() == 1 and read(store.rows()) == want
    store.append("r4", table(spark, ("a", 5, "ok")))
    store.retain([F.desc("at")], 1)
    assert store.generation() == 2 and read(store.rows()) == [("a", 5, "ok", "r4"), ("b", 2, "ok", "r2")]


def test_columns_of_the_store_are_its_own(spark, tmp_path):
    with pytest.raises(ValueError):
        SnapshotStore(spark, str(tmp_path), "k string, store_run string", ["k"])
    with pytest.raises(ValueError):
        SnapshotStore(spark, str(tmp_path), "v string", ["k"])


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
