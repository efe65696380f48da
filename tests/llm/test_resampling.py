"""Importance resampling against plain Python, and its parts against sorted lists and zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from rankloom.llm import resampling
from rankloom.llm.byte_words import slices, word_crcs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(f.encode()) % 10_000 for f in runs)


def plain(docs, target, least=20, per_cent=5):
    """docs: (doc_id, text), without null ids that repeat."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = sum((f for _, _, f in found), Counter()), sum((features(x)[1] for x in target), Counter())
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain(b) for b, k in f.items())
        rows.append((i, n, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = order[: len(order) * per_cent // 100]
    rank = {id(r): k + 1 for k, r in enumerate(drawn)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=repr)


def ours(docs, target, **how):
    return sorted((tuple(r) for r in resampling.resample(docs, target, **how).collect()), key=repr)


def test_documents_against_plain_python(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ours(docs, target) == plain(rows, [r.text for r in target.collect()])


def test_awkward_texts_and_clashing_columns(spark):
    long_word, many = "é" * 3000, " ".join(f"w{i % 977}" for i in range(700_000))
    texts = [None, "", "   ", "Ä ä A a 1 _ b", long_word, f"x {long_word} y {long_word}", many, "one two", "one two", "\U0001f600 smile\u0000nul"]
    rows = list(enumerate(texts)) + [(None, "no id here"), (3, "Ä ä A a 1 _ b")]
    docs = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t in rows], "doc_id long, text string, row int, key string, score double")
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    assert ours(docs, target, least_words=1, per_cent=50) == plain(rows, ["one two three"], 1, 50)


def test_draws_of_all_sizes_with_many_runs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([2, 25, 25, 30])))) for i in rng.sample(range(10_000), 600)]
    monkeypatch.setattr(resampling, "RUN_ROWS", 20)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 3)
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b c d",)], "text string")
    for per_cent in (0, 1, 40, 100):
        assert ours(docs, target, per_cent=per_cent) == plain(rows, ["a b c d"], 20, per_cent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    rows = [(1, "a b"), (2, "c")]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), none, least_words=1, per_cent=100) == plain(rows, [], 1, 100)


def test_tournament_merges_as_sorting_does():
    rng = random.Random(5)
    for n in (1, 2, 3, 17):
        runs = [sorted((rng.randrange(50), k, i) for i in range(rng.randrange(40))) for k in range(n)]
        blocks = [run[at : at + 4] for run in runs for at in range(0, len(run), 4)]
        blocks = [{"head_score": -b[0][0], "head_key": b[0][1], "head_row": b[0][2], "score": [-x[0] for x in b], "key": [x[1] for x in b], "row": [x[2] for x in b], "n_features": [0] * len(b), "weight": [0] * len(b)} for b in sorted(blocks)]
        want = sorted(x for run in runs for x in run)
        for take in (0, 1, len(want) // 2, len(want), len(want) + 5):
            assert [x[:3] for x in resampling.merged(iter(blocks), take)] == want[:take]


def test_checksums_are_those_of_zlib():
    words = [b"a", b"", b"abc", b"x" * 47, b"y" * 48, b"z" * 49, b"q" * 1000]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    assert word_crcs(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_slices_hold_every_row_once(most):
    column = pa.array(["ab", None, "", "cdé", "f" * 20, ""])
    got = [bytes(d[o[i] : o[i + 1]]).decode() for a, b, d, o in slices(column, most) for i in range(b - a)]
    assert got == ["ab", "", "", "cdé", "f" * 20, ""]
    got = [bytes(d[o[i] : o[i + 1]]).decode() for a, b, d, o in slices(column.slice(2, 3), most) for i in range(b - a)]
    assert got == ["", "cdé", "f" * 20]
