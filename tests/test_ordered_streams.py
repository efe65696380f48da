"""State machines over disordered and late events, and what a listener is told."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rankloom.streaming import ordered, progress

KIND = "key long, ts timestamp, seq long, kind string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Batches of (key, minute, seq, kind) as a stream, one file each, and an event long after them."""

    def make(*batches):
        for rows in [*batches, [(-1, 1_000_000, 0, "queue")]]:
            made = spark.createDataFrame([(k, at(m).isoformat(), s, kind) for k, m, s, kind in rows], "key long, ts string, seq long, kind string")
            made.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def rows_of(stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return [r for r in stream.sparkSession.read.schema(stream.schema).parquet(out).collect() if r.key >= 0]


def minutes(rows):
    zero = int(at(0).replace(tzinfo=dt.UTC).timestamp())
    return sorted((r.key, (r.at // 1000 - zero) / 60, r.cause == "expired", r.seq, r.cause, r.state) for r in rows)


def test_tasks_in_order_of_their_time(stream, tmp_path):
    events = stream(
        [(1, 5, 2, "reserve"), (1, 0, 1, "queue"), (2, 0, 1, "queue"), (3, 1, 1, "reserve")],  # disordered; reserved before it is queued
        [(1, 8, 3, "post"), (2, 2, 2, "reserve"), (2, 40, 3, "post"), (4, 30, 1, "queue"), (4, 31, 2, "reserve"), (4, 46, 3, "post")],  # 2 is posted too late, 4 at the last moment
        [(1, 60, 4, "complete"), (1, 70, 5, "queue"), (5, 70, 1, "queue"), (5, 71, 2, "reserve"), (6, 70, 1, "queue")],
        [(6, 1, 2, "reserve"), (1, 71, 6, "fail")],  # more than the delay behind minute 71: dropped
    )
    got = [(k, m, cause, state) for k, m, _, _, cause, state in minutes(rows_of(ordered.task_log(events, 15 * 60_000, "30 minutes"), tmp_path))]
    assert got == [
        (1, 0, "queue", "pending"), (1, 5, "reserve", "posting"), (1, 8, "post", "posted"), (1, 60, "complete", "complete"), (1, 70, "queue", "pending"), (1, 71, "ignored", "pending"),
        (2, 0, "queue", "pending"), (2, 2, "reserve", "posting"), (2, 17, "expired", "pending"), (2, 40, "ignored", "pending"),
        (3, 1, "ignored", "new"),
        (4, 30, "queue", "pending"), (4, 31, "reserve", "posting"), (4, 46, "post", "posted"),
        (5, 70, "queue", "pending"), (5, 71, "reserve", "posting"), (5, 86, "expired", "pending"),  # by its timer alone
        (6, 70, "queue", "pending"),
    ]


def test_quotas_of_a_window_and_a_day(stream, tmp_path):
    day = 24 * 60
    events = stream([(1, m, m, "x") for m in (3, 1, 2, 61, 62, 63)], [(1, 130, 130, "x"), (1, 200, 200, "x"), (1, day, 9000, "x"), (2, 5, 1, "x")])
    got = {(r.key, r.seq): r.decision for r in rows_of(ordered.quota_log(events.drop("kind"), 3_600_000, 2, 5, "30 days"), tmp_path)}
    assert got == {(1, 1): "reserved", (1, 2): "reserved", (1, 3): "window-limit", (1, 61): "reserved", (1, 62): "reserved", (1, 63): "window-limit", (1, 130): "reserved", (1, 200): "day-limit", (1, 9000): "reserved", (2, 1): "reserved"}


def test_progress(stream, spark, tmp_path):
    rows = progress.progress_of(stream([(1, 0, 1, "a"), (1, 1, 2, "a")], [(1, 2, 3, "a")]).select("seq"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    assert sorted(map(tuple, rows)) == [(0, 2), (1, 1), (2, 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_waiting_events_are_few_rows_of_the_state():
    """Ten thousand events of a key go into the state, and come back in order, as a row for each few thousand."""
    import pandas as pd
    from rankloom.streaming.ordered import PACKED, Quota

    class Held:
        rows, n_put = [], 0

        def appendList(self, rows):
            self.put([*self.rows, *rows])

        def put(self, rows):
            self.rows, self.n_put = rows, self.n_put + 1

        update = put

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows) if self is quota.waiting else self.rows

        def clear(self):
            self.rows = []

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    quota, timers = Quota(1000, 1, 10**6), []
    quota.waiting, quota.machine, quota.handle = Held(), Held(), type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    events = pd.DataFrame({"ts": [1 + i * 7919 % 10_000 for i in range(10_000)], "seq": range(10_000), "kind": "request"})
    list(quota.handleInputRows((1,), iter([events[:6000], events[6000:]]), Clock(0)))
    assert timers == [1] and len(quota.waiting.rows) <= 2 + 10_000 // PACKED
    [out] = quota.handleExpiredTimer((1,), Clock(6000), None)
    assert out["at"].tolist() == list(range(1, 6001)) and (out["decision"] == "reserved").sum() == 7
    assert sum(len(ts) for ts, _, _ in quota.waiting.rows) == 4000 and timers == [1, 6001]


def test_events_come_in_as_a_row_of_a_key():
    """What a task has of a key's events is one row, with the time of the newest; those without a time are dropped."""
    import pyarrow as pa
    from rankloom.streaming.ordered import grouped

    def batch(rows):
        key, ts, seq, kind = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "event_time": pa.array(ts, pa.timestamp("us", "UTC")), "ts": pa.array(ts, pa.int64()), "seq": pa.array(seq, pa.int64()), "kind": pa.array(kind, pa.string())})

    rows = [(i % 3, 1 + i * 7919 % 30_000, i, "request") for i in range(30_000)]
    made = list(grouped(iter([batch(rows[:10_000]), batch([(None, None, 1, "x")]), batch([(4, None, 1, "x"), *rows[10_000:], (None, 5, 7, None)])])))
    got = [r for b in made for r in b.to_pylist()]
    assert [(r["key"], r["event_time"].microsecond, len(r["ts"])) for r in got] == [(k, max(t for x, t, _, _ in rows if x == k), 10_000) for k in range(3)] + [(None, 5, 1)]
    assert sorted((r["key"], *e) for r in got[:3] for e in zip(r["ts"], r["seq"], r["kind"], strict=True)) == sorted(rows)
    assert list(grouped(iter([batch([(1, None, 1, "x")])]))) == []


@pytest.mark.parametrize("n", [9, 2000])
def test_parts_of_the_replay_are_batches_of_several_files(spark, tmp_path, n):
    """Each part has its files, be its events fewer than they, and comes as one batch."""
    import duckdb
    from rankloom.streaming import queries

    rows = [(i, f"2024-01-{1 + i * 11 % 30:02d} 00:00:{i % 60:02d}", i % 7, ["view", "click", "signup", "purchase", "error"][i % 5]) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = queries.replayed(spark, str(tmp_path))
    root = stream._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0]
    files = spark.read.parquet(root).inputFiles()
    assert len(files) == queries.PARTS * queries.FILES + 1 and queries.FILES > 1
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        for name in ("stream_progress", "stream_tasks"):
            want = [r for r in con.execute(queries.ORACLE_SQL[name]).fetchall() if name == "stream_tasks" or r[1]]
            assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want), name
