"""Fingerprints of texts as multisets of paragraphs.

A paragraph is a line. It is hashed to a wide vector: lanes modulo 2**64 from a digest of the whole line, and lanes modulo 2**16 in which
each of its five-word shingles adds or takes one. The fingerprint of a text is the sum over its paragraphs, lane by lane, so it doesn't
depend on their order, and paragraphs can be added and taken out without the rest of the text. Texts with the same paragraphs have equal
fingerprints; the shingle lanes say how much of two texts is alike, as the sums of shared shingles don't cancel out.
That share is an estimate, off by 0.07 or so, and only holds while no lane has gone round (a shingle that a text repeats 30,000 times).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import word_bounds, word_crcs
from .workers import releasing

WORDS = 5
EXACT, LANES = 8, 256
#: Characters of texts that are hashed together, and words whose shingles are held at once.
GROUP_CHARS, WINDOW = 1_000_000, 500_000
_IN_WORD = np.arange(256) > 32
#: Odd numbers that mix the words of a shingle.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def vectors(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of paragraphs: the sums of its digest lanes (uint64) and of its shingle lanes (uint16)."""
    lines = [line for g in groups for line in g]
    exact, lanes = np.zeros((len(groups), EXACT), np.uint64), np.zeros((len(groups), LANES), np.int64)
    if not lines:
        return exact, lanes.astype(np.uint16)
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in lines), "<u8").reshape(-1, EXACT)
    heads = np.flatnonzero(np.diff(group_of, prepend=-1))
    exact[group_of[heads]] = np.add.reduceat(digests, heads, axis=0)

    data = np.frombuffer(b"".join(lines), np.uint8)
    starts, ends, line_of = word_bounds(data, np.concatenate([[0], np.cumsum([len(x) for x in lines])]), _IN_WORD)
    n_words = np.bincount(line_of, minlength=len(lines))
    flat = lanes.reshape(-1)
    for at in range(0, len(starts), WINDOW):
        crc = word_crcs(data, starts[at : at + WINDOW + WORDS - 1], ends[at : at + WINDOW + WORDS - 1]).astype(np.uint64) + np.uint64(1)
        line = line_of[at : at + len(crc)]
        n = min(WINDOW, len(crc))
        # a shingle begins at a word that has enough words after it in its line, or at the first word of a shorter line
        first = np.ones(n, bool)
        first[1:] = line[1:n] != line[: n - 1]
        if at:
            first[0] = line_of[at] != line_of[at - 1]
        whole = np.zeros(n, bool)
        whole[: max(0, len(line) - WORDS + 1)] = (line[: max(0, len(line) - WORDS + 1)] == line[WORDS - 1 :])[:n]
        here = np.flatnonzero(whole | first & (n_words[line[:n]] < WORDS))
        h = np.zeros(len(here), np.uint64)
        for j in range(WORDS):
            k = np.minimum(here + j, len(crc) - 1)
            h += np.where((here + j < len(crc)) & (line[k] == line[here]), crc[k], np.uint64(0)) * _MIX[j]
        h = _finish(h)
        lane = group_of[line[here]] * LANES + (h >> np.uint64(56)).astype(np.int64)
        flat += np.bincount(lane, np.where(h & np.uint64(1), 1.0, -1.0), len(flat)).astype(np.int64)
    return exact, lanes.astype(np.uint16)


def shown(exact: np.ndarray, lanes: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + lanes.astype("<u2").tobytes()).decode()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """From the shingle lanes of two texts: twice what they share over what they have together, within 0 and 1."""
    x, y = a.astype(np.int16).astype(np.float64), b.astype(np.int16).astype(np.float64)
    total = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / total))) if total else 0.0


class Fingerprint:
    """A fingerprint that paragraphs are added to and taken out of."""

    def __init__(self, text: str | None = None) -> None:
        self.exact, self.lanes = (x[0] for x in vectors([paragraphs(text or "") if text is not None else []]))

    @classmethod
    def read(cls, shown: str) -> Fingerprint:
        raw, out = base64.b64decode(shown), cls()
        out.exact, out.lanes = np.frombuffer(raw, "<u8", EXACT).copy(), np.frombuffer(raw, "<u2", LANES, 8 * EXACT).copy()
        return out

    def insert(self, *texts: str) -> Fingerprint:
        exact, lanes = vectors([[x.encode() for x in texts]])
        self.exact, self.lanes = self.exact + exact[0], self.lanes + lanes[0]
        return self

    def delete(self, *texts: str) -> Fingerprint:
        exact, lanes = vectors([[x.encode() for x in texts]])
        self.exact, self.lanes = self.exact - exact[0], self.lanes - lanes[0]
        return self

    def likeness(self, other: Fingerprint) -> float:
        return 1.0 if str(self) == str(other) else alike(self.lanes, other.lanes)

    def __str__(self) -> str:
        return shown(self.exact, self.lanes)


def paragraphs(text: str) -> list[bytes]:
    return text.encode().split(b"\n")


def text_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text). A null text is an empty one, which is one empty paragraph."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _stretches(zip(batch.column(0), batch.column(1), strict=True)):
                exact, lanes = vectors([paragraphs(t) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array([shown(e, x) for e, x in zip(exact, lanes, strict=True)])], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, fingerprint string")


def _stretches(rows: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for i, t in rows:
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= GROUP_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


# --- edits ----------------------------------------------------------------------------------------------------------------------------------


def split_edit(text: str, following: str) -> tuple[list[bytes], list[bytes], list[bytes], str]:
    """When the second half of text is replaced by the beginning of following: paragraphs that stay, that go, that come, and the new text."""
    half = len(text) // 2
    head, new = text[: len(text) - half], following[:half]
    cut = head.rfind("\n")
    stay = paragraphs(head[:cut]) if cut >= 0 else []
    return stay, paragraphs(text[cut + 1 :]), paragraphs(head[cut + 1 :] + new), head + new


_EDITS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _audit(rows: list[tuple[int, bool, object, str]], id_type: pa.DataType) -> pa.RecordBatch:
    """Each row but the last with the one after it; rows that only stand after others are left out."""
    parts = [split_edit(row[3], after[3] if row[0] == after[0] else "") for row, after in zip(rows, rows[1:], strict=False)]
    groups = [g for stay, go, come, _ in parts for g in (stay, go, come)] + [paragraphs(rows[-1][3])]
    exact, lanes = vectors(groups)
    sums = lambda x: np.vstack([x[0:-1:3] + x[1:-1:3], x[-1:]])
    own, own_lanes = sums(exact), sums(lanes)
    out = []
    for i, (row, (*_, edited)) in enumerate(zip(rows, parts, strict=False)):
        if row[1]:
            continue
        e, x = own[i] - exact[3 * i + 1] + exact[3 * i + 2], own_lanes[i] - lanes[3 * i + 1] + lanes[3 * i + 2]
        mine, changed, after = shown(own[i], own_lanes[i]), shown(e, x), shown(own[i + 1], own_lanes[i + 1])
        near = [1.0 if mine == s else alike(own_lanes[i], v) for s, v in ((changed, x), (after, own_lanes[i + 1]))]
        out.append((row[2], len(row[3]), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, *near))
    kinds = [("doc_id", id_type), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, tail, doc_id, text) in order, a stretch at a time; the last row of a stretch begins the next one."""
    held, size, kind = [], 0, None
    for batch in batches:
        kind = batch.schema.types[2]
        for row in zip(*batch.columns, strict=True):
            held.append((row[0].as_py(), row[1].as_py(), row[2].as_py(), row[3].as_py()))
            size += len(held[-1][3])
            if size >= GROUP_CHARS and len(held) > 1:
                yield _audit(held, kind)
                held = held[-1:]
                size = len(held[0][3])
    if len(held) > 1:
        yield _audit(held, kind)


def audit_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs (doc_id, text).

    The edited text has the beginning of the next row's text in place of its second half; the last row is followed by the first. Its
    fingerprint is the text's, less the paragraphs that go, with those that come. Rows are in the order of doc_id, nulls first; repeated
    ids by their texts. Null texts are empty; a row on its own follows itself; an empty table gives no rows; other columns aren't read.

    Texts move once, to ranges of doc_id; the first row of a range also goes to the end of the range before it.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], F.lit(10_000)).alias("at")).first()["at"] or []  # a number for each range
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "left").astype(np.int32))

    firsts = dict(keyed.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("first")).collect())
    ranges = sorted(firsts)  # one row for each range
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}
    places = np.full(len(cuts) + 1, -1, np.int64)
    heads = np.zeros(len(cuts) + 1, np.int64)
    for r in ranges:
        places[r], heads[r] = before[r], firsts[r]

    @F.pandas_udf("array<int>")
    def goes_to(key):
        import pandas as pd

        at = np.searchsorted(cuts, key.to_numpy(), "left")
        first = heads[at] == key.to_numpy()
        return pd.Series([[int(r), int(places[r])] if f else [int(r)] for r, f in zip(at, first, strict=True)])

    sent = keyed.select("doc_id", "text", "key", F.posexplode(goes_to("key")).alias("copy", "range"))
    sent = sent.select("range", (F.col("copy") == 1).alias("tail"), "doc_id", "text", "key").repartitionById(n, F.col("range"))
    rows = sent.sortWithinPartitions("range", "tail", "key", "text").select("range", "tail", "doc_id", "text")
    return rows.mapInArrow(releasing(_in_order), f"doc_id {kind}, {_EDITS}")
