"""Importance resampling of documents towards a target distribution, without replacement.

A feature is a run of one to three words; texts are compared by how often hashed buckets of features occur in them. A document's weight sums
what its buckets gain in the target texts; Gumbel noise by its id turns the highest scores into a draw that is proportional to weights.

The draw is a merge of sorted runs: eligible rows are cut into ranges of the order of scores, each range is a handful of runs sorted in
memory and written in blocks, and a tournament tree merges the runs of a range, block by block as their first keys come up, until the
count of the draw is reached. Ranges behind that count are never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import joined, slices, word_bounds, word_crcs
from .storage import materialize
from .workers import releasing

N_BUCKETS = 10_000
LEAST_WORDS, PER_CENT, SEED = 20, 5, 42
#: Rows sorted in memory at once, and rows of a block, of which a merge holds one for each run.
RUN_ROWS, BLOCK_ROWS = 50_000, 1_000
#: Words whose features are held at once.
WINDOW = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def feature_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Windows of words: the row of each word, and for runs of one, two and three words the bucket of the run that begins there and
    whether there is one. data is in lower case."""
    starts, ends, rows = word_bounds(data, offsets, _IN_WORD)
    for at in range(0, len(starts), WINDOW):
        s, e, r = (x[at : at + WINDOW + 2] for x in (starts, ends, rows))
        n, lengths, crc = min(WINDOW, len(s)), e - s, word_crcs(data, s, e)
        two = joined(crc[:-1], crc[1:], lengths[1:])
        three = joined(two[:-1], crc[2:], lengths[2:]) if len(s) > 2 else two[:0]
        of = [crc[:n], two[:n], three[:n]]
        yield r[:n], [x % np.uint32(N_BUCKETS) for x in of], [np.ones(n, bool), (r[:-1] == r[1:])[:n], (r[:-2] == r[2:])[:n] if len(r) > 2 else np.zeros(0, bool)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(N_BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            for _, buckets, there in feature_buckets(_LOWER[data], offsets):
                for b, ok in zip(buckets, there, strict=True):
                    counts += np.bincount(b[ok], minlength=N_BUCKETS)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column text fall into each bucket: N_BUCKETS numbers, whatever the table's size."""
    counts = np.zeros(N_BUCKETS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(releasing(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the logarithm of its share in the target over that in the source, smoothed by one and rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + N_BUCKETS) / ((s + 1) * (t.sum() + N_BUCKETS)))).astype(np.int64)


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, end, data, offsets in slices(batch.column("text")):
                for rows, buckets, there in feature_buckets(_LOWER[data], offsets):
                    heads = np.flatnonzero(np.diff(rows, prepend=-1))  # rows ascend
                    at = first + rows[heads]
                    n_words[at] += np.diff(heads, append=len(rows))
                    for b, ok in zip(buckets, there, strict=True):
                        if len(ok) < len(rows):  # the last words begin no longer run
                            b, ok = np.pad(b, (0, len(rows) - len(b))), np.pad(ok, (0, len(rows) - len(ok)))
                        n_features[at] += np.add.reduceat(ok.astype(np.int64), heads)
                        weight[at] += np.add.reduceat(np.where(ok, gains[b], 0), heads)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def score_documents(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score, the weight plus Gumbel noise by doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(releasing(_weigh(gains)), f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(uniform))))


# --- the draw -------------------------------------------------------------------------------------------------------------------------------

_ROW = ["score", "key", "row", "n_features", "weight"]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of runs of RUN_ROWS rows each, sorted: the keys of its first row, and a list for each column."""
    names = ["range", "run", "n", *(f"head_{c}" for c in _ROW[:3]), *_ROW]
    held, n, run = [], 0, 0

    def close() -> pa.RecordBatch:
        nonlocal held, n, run
        at, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((columns[2], columns[1], -columns[0]))
        columns = [c[order] for c in columns]
        cuts = np.arange(0, len(order), BLOCK_ROWS)
        lists = [pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), pa.array(c)) for c in columns]
        out = [pa.array(at[cuts].astype(np.int32)), pa.array(np.full(len(cuts), run, np.int32)), pa.array(np.diff(cuts, append=len(order)))]
        held, n, run = [], 0, run + 1
        return pa.RecordBatch.from_arrays([*out, *(pa.array(c[cuts]) for c in columns[:3]), *lists], names)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, RUN_ROWS - n)
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            at, n = at + part.num_rows, n + part.num_rows
            if n == RUN_ROWS:
                yield close()
    if n:
        yield close()


_BLOCK = "range int, run int, n long, head_score long, head_key long, head_row long, " + ", ".join(f"{c} array<long>" for c in _ROW)


class Tournament:
    """Merges sorted runs: a tree of matches between their first rows. A row leaves from the root, and only the matches on the way of
    its run are played again."""

    def __init__(self) -> None:
        self.size, self.runs, self.free = 1, [None], [0]
        self.winner = [0, 0]

    def _play(self, leaf: int) -> None:
        at = (leaf + self.size) // 2
        while at:
            a, b = (self.winner[2 * at], self.winner[2 * at + 1])
            left, right = self.runs[a], self.runs[b]
            self.winner[at] = a if right is None or left is not None and left[0] <= right[0] else b
            at //= 2

    def add(self, rows: Iterator[tuple]) -> None:
        """rows: an iterator of rows in order; rows that compare equal go out in any order."""
        if (head := next(rows, None)) is None:
            return
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))
            self.runs += [None] * self.size
            self.size *= 2
            self.winner = [0] * self.size + list(range(self.size))
            for leaf in range(0, self.size, 2):
                self._play(leaf)
        leaf = self.free.pop()
        self.runs[leaf] = (head, rows)
        self._play(leaf)

    def first(self) -> tuple | None:
        run = self.runs[self.winner[1]] if self.size > 1 else self.runs[0]
        return run and run[0]

    def pop(self) -> tuple:
        leaf = self.winner[1] if self.size > 1 else 0
        row, rows = self.runs[leaf]
        head = next(rows, None)
        self.runs[leaf] = None if head is None else (head, rows)
        if head is None:
            self.free.append(leaf)
        if self.size > 1:
            self._play(leaf)
        return row


def merged(blocks: Iterator[dict], take: int) -> Iterator[tuple]:
    """The first `take` rows of all blocks, which come in the order of their first rows: a block is opened when the merge has come to it,
    so one block of each run is open at most."""
    tree, waiting = Tournament(), next(blocks, None)
    for _ in range(take):
        while waiting is not None and (tree.first() is None or (-waiting["head_score"], waiting["head_key"], waiting["head_row"]) <= tree.first()[:3]):
            tree.add(zip(*([-s for s in waiting["score"]], *(waiting[c] for c in _ROW[1:])), strict=True))
            waiting = next(blocks, None)
        if tree.first() is None:
            return
        yield tree.pop()


def _merge(plan: dict[int, tuple[int, int]]):
    """plan: of each range, the rows before it and how many of its own are drawn."""
    names = ["rank", *_ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few blocks become Python objects at a time
        blocks = (row for batch in batches for at in range(0, batch.num_rows, 8) for row in batch.slice(at, 8).to_pylist())
        block = next(blocks, None)
        while block is not None:
            range_, onward = block["range"], None

            def own(first=block, range_=range_):
                nonlocal onward
                yield first
                for b in blocks:
                    if b["range"] != range_:
                        onward = b
                        return
                    yield b

            before, take = plan[range_]
            mine, rows = own(), []
            for i, (neg, *rest) in enumerate(merged(mine, take)):
                rows.append((before + i + 1, -neg, *rest))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            for _ in mine:  # blocks behind the last row that is drawn
                pass
            block = onward

    return run


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of docs (doc_id, text), drawn towards target (text).

    Of the N rows with at least least_words words, the floor(per_cent * N / 100) highest scores are drawn and have ranks from 1; the rank
    of all others is null. Ties go to the smaller doc_id, rows without doc_id come last (their noise is that of an empty id), repeated
    rows are rows of their own. Null and empty texts have no features and weight 0. An empty table gives no rows; an empty target
    still has gains, from smoothing. Other columns aren't read.
    """
    scored = score_documents(docs, bucket_gains(bucket_counts(docs), bucket_counts(target)))
    # the number of a row is written once, so that retried tasks agree
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("key")
    eligible = scored.filter(F.col("n_words") >= least_words).select("score", key, "row", "n_features", "weight")
    ranges = eligible.repartitionByRange(F.desc("score"), "key", "row").select(F.spark_partition_id().alias("range"), *_ROW)
    runs = materialize(ranges.mapInArrow(_sorted_runs, _BLOCK), "runs")
    sizes = sorted(runs.groupBy("range").agg(F.sum("n")).collect())  # a row for each of Spark's partitions
    draw, before, plan = sum(n for _, n in sizes) * per_cent // 100, 0, {}
    for range_, n in sizes:
        if before < draw:
            plan[range_] = (before, min(n, draw - before))
        before += n
    output = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*output, F.lit(None).cast("long").alias("rank"))
    wanted = runs.filter(F.col("range") <= max(plan)).repartition("range")
    wanted = wanted.sortWithinPartitions("range", F.desc("head_score"), "head_key", "head_row")
    drawn = materialize(wanted.mapInArrow(_merge(plan), "rank long, score long, key long, row long, n_features long, weight long"), "drawn")
    last = drawn.filter(F.col("rank") == draw).first()  # who comes before this row is drawn
    score, at = F.col("score"), F.struct(key, F.col("row"))
    in_draw = (F.col("n_words") >= least_words) & ((score > last["score"]) | (score == last["score"]) & (at <= F.struct(F.lit(last["key"]).alias("key"), F.lit(last["row"]).alias("row"))))
    null_id = F.col("key") == 2**63 - 1
    named = drawn.select(F.when(~null_id, F.col("key")).alias("doc_id"), "n_features", "weight", "score", "rank")
    return named.unionByName(scored.filter(~in_draw).select(*output, F.lit(None).cast("long").alias("rank")))
