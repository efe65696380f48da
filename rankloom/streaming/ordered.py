"""State machines over streams: each key's events in the order of their time, and what happens when nothing comes.

Events wait in the state until the watermark has passed them, so they are met in order however they arrive; those that come after that
are dropped. Timers end reservations without an event.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers and lists.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Events of a row of the state; events that a task gathers before it groups them by key.
PACKED, GATHERED = 4096, 1 << 19


def _grouped(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events as a row for each key: its newest event_time, and lists of ts, seq and kind. What has no time is dropped."""
    t = pa.Table.from_batches(batches)
    t = t.filter(pc.is_valid(t["event_time"])).sort_by([("key", "ascending"), ("event_time", "ascending")]).combine_chunks()
    if t.num_rows:
        ends = pc.run_end_encode(t["key"].chunk(0)).run_ends
        offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
        lists = [pa.ListArray.from_arrays(offsets, t[c].chunk(0)) for c in ("ts", "seq", "kind")]
        newest = t.select(["key", "event_time"]).take(pc.subtract(ends, 1)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in newest.columns), *lists], ["key", "event_time", "ts", "seq", "kind"])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events (key, event_time, ts, seq, kind) by key within a task, as what costs in a state machine is the row that comes in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield from _grouped(held)
            held = []
    if held:
        yield from _grouped(held)


def _flat(column: pd.Series) -> np.ndarray:
    """The values of single events, or of lists of them."""
    return np.concatenate([np.atleast_1d(x) for x in column])


def _objects(values: Sequence) -> np.ndarray:
    """Values as they are, so that a number or none stays a number."""
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _packed(ts: list[int], seq: list[int], kind: list[str]) -> list[tuple]:
    """Events as few rows of the state, which cost more than what they hold; arrays (l, which the JVM reads; it has no q) and JSON, as lists
    are looked at item by item."""
    parts = [slice(i, i + PACKED) for i in range(0, len(ts), PACKED)]
    return [(array("l", ts[p]), array("l", seq[p]), json.dumps(kind[p])) for p in parts]


def _unpacked(rows: Iterator[tuple]) -> Iterator[tuple[int, int, str]]:
    for ts, seq, kind in rows:
        yield from zip(ts, seq, json.loads(kind), strict=True)


class Ordered(StatefulProcessor):
    """Subclasses say what an event does. fields: the machine's state; columns: its output."""

    fields: str
    empty: tuple
    columns: list[str]

    def step(self, state: tuple, ts: int, seq: int, kind: str) -> tuple[tuple, list[tuple]]:
        """The state after an event, and rows to put out."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When this state ends by itself."""
        return None

    def lapse(self, state: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts array<long>, seq array<long>, kind string")
        self.machine = handle.getValueState("machine", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for d in rows:
            ts, seq, kind = (_flat(d[c]) for c in ("ts", "seq", "kind"))
            if (new := ts > passed).any():
                self.waiting.appendList(_packed(ts[new].tolist(), seq[new].tolist(), kind[new].tolist()))
                first = min(int(ts[new].min()), first if first is not None else int(ts[new].min()))
        if first is not None:
            self.handle.registerTimer(first)
        yield self._table([], key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(_unpacked(self.waiting.get())) if self.waiting.exists() else []
        cut = bisect_right(held, passed, key=lambda x: x[0])
        ready, later = held[:cut], held[cut:]
        state, out = tuple(self.machine.get()) if self.machine.exists() else self.empty, []
        for ts, seq, kind in [*ready, (passed + 1, 0, None)]:
            while (end := self.deadline(state)) is not None and end < ts:
                state, more = self.lapse(state)
                out += more
            if kind is not None:
                state, more = self.step(state, ts, seq, kind)
                out += more
        if ready:
            if later:
                self.waiting.put(_packed(*map(list, zip(*later, strict=True))))
            else:
                self.waiting.clear()
        self.machine.update(state)
        for at in (later[0][0] if later else None, self.deadline(state)):
            if at is not None:
                self.handle.registerTimer(at)
        yield self._table(out, key)

    def _table(self, rows: list[tuple], key) -> pd.DataFrame:
        columns = zip(*rows, strict=True) if rows else [()] * len(self.columns)
        return pd.DataFrame(dict(zip(["key", *self.columns], map(_objects, [[key[0]] * len(rows), *columns]), strict=True)))

    def close(self) -> None:
        pass


def _run(events: DataFrame, machine: Ordered, late: str, schema: str) -> DataFrame:
    """events (key, ts timestamp, seq, kind), put in order and fed to the machine."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.select("key", F.col("ts").alias("event_time"), F.unix_millis("ts").alias("ts"), F.col("seq").cast("long").alias("seq"), "kind")
    rows = timed.mapInArrow(grouped, f"key {events.schema['key'].dataType.simpleString()}, event_time timestamp, ts array<long>, seq array<long>, kind array<string>")
    return rows.withWatermark("event_time", late).groupBy("key").transformWithStateInPandas(machine, schema, "Append", "EventTime")


class Tasks(Ordered):
    """A task goes from pending to posting when it is reserved, to posted, and to complete or failed. What doesn't fit its
    state is ignored. A reservation that isn't posted in time makes it pending again; an ended task can be queued anew."""

    fields, empty = "state string, until long", ("new", -1)
    columns = ["at", "seq", "cause", "state"]
    moves = {
        ("new", "queue"): "pending", ("complete", "queue"): "pending", ("failed", "queue"): "pending", ("pending", "reserve"): "posting", ("posting", "post"): "posted", ("posted", "complete"): "complete", ("posting", "fail"): "failed", ("posted", "fail"): "failed",
    }

    def __init__(self, reserved_ms: int) -> None:
        self.reserved_ms = reserved_ms

    def step(self, state, ts, seq, kind):
        to = self.moves.get((state[0], kind))
        if to is None:
            return state, [(ts, seq, "ignored", state[0])]
        return (to, ts + self.reserved_ms if to == "posting" else -1), [(ts, seq, kind, to)]

    def deadline(self, state):
        return state[1] if state[0] == "posting" else None

    def lapse(self, state):
        return ("pending", -1), [(state[1], None, "expired", "pending")]


def task_log(events: DataFrame, reserved_ms: int, late: str) -> DataFrame:
    """key, at (milliseconds), seq, cause and state: what became of each event (key, ts, seq, kind), and each reservation that expired.

    kind: queue, reserve, post, complete or fail. An event at the very moment when a reservation ends still finds it.
    """
    return _run(events, Tasks(reserved_ms), late, f"key {events.schema['key'].dataType.simpleString()}, at long, seq long, cause string, state string")


class Quota(Ordered):
    """So many requests in a window and in a day; days are those of UTC."""

    fields, empty = "day long, in_day long, window long, in_window long", (-1, 0, -1, 0)
    columns = ["seq", "at", "decision"]

    def __init__(self, window_ms: int, per_window: int, per_day: int) -> None:
        self.window_ms, self.per_window, self.per_day = window_ms, per_window, per_day

    def step(self, state, ts, seq, kind):
        day, window = ts // 86_400_000, ts // self.window_ms
        in_day, in_window = state[1] if state[0] == day else 0, state[3] if state[2] == window else 0
        decision = "day-limit" if in_day >= self.per_day else "window-limit" if in_window >= self.per_window else "reserved"
        took = int(decision == "reserved")
        return (day, in_day + took, window, in_window + took), [(seq, ts, decision)]


def quota_log(requests: DataFrame, window_ms: int, per_window: int, per_day: int, late: str) -> DataFrame:
    """key, seq, at and decision of each request (key, ts, seq): reserved, or the limit that stands against it, the day's first."""
    return _run(requests.withColumn("kind", F.lit("request")), Quota(window_ms, per_window, per_day), late, f"key {requests.schema['key'].dataType.simpleString()}, seq long, at long, decision string")
