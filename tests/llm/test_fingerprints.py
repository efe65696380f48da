"""Multiset fingerprints: edits against plain Python, order, insertion and deletion, likeness."""

import hashlib
import random

import pytest
from rankloom.llm import fingerprints, queries
from rankloom.llm.fingerprints import Fingerprint, audit_edits, text_fingerprints

SF = "/root/testdata/sf0.001"


def check(rows, docs):
    """rows of audit_edits over docs (doc_id, text), which are in order."""
    assert len(rows) == len(docs)
    want = []
    for i, (k, text) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = Fingerprint(text), Fingerprint(edited), Fingerprint(after)
        want.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(following)))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted((w[:5] for w in want), key=repr)
    assert sorted(r[5] for r in rows) == pytest.approx(sorted(w[5] for w in want))
    assert sorted(r[6] for r in rows) == pytest.approx(sorted(w[6] for w in want))
    return rows


def test_documents_against_plain_python(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = check(queries.multiset_fingerprints(spark, SF).collect(), docs)
    of_text = {}
    for r in rows:
        of_text.setdefault(hashlib.sha256(dict(docs)[r.doc_id].encode()).hexdigest(), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in of_text.values())
    edited, after = sum(r.near_edited for r in rows) / len(rows), sum(r.near_next for r in rows) / len(rows)
    assert 0.4 < edited < 0.6 and after < 0.1


def test_awkward_rows(spark):
    long = "\n".join(" ".join(f"w{(i * j) % 991}" for j in range(30)) for i in range(4000))
    texts = [None, "", "\n", "a", "é😀\n\nb", long, "same words in both texts here", "same words in both texts here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "b"), (None, "none")]
    docs = spark.createDataFrame([(i, t, 1, True, "k") for i, t in rows], "doc_id long, text string, range int, tail boolean, key string")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = check(audit_edits(docs).collect(), order)
    assert {r.near_next for r in found if r.doc_id == 6} == {1.0}


def test_few_rows(spark):
    kind = "doc_id long, text string"
    assert audit_edits(spark.createDataFrame([], kind)).count() == 0
    check(audit_edits(spark.createDataFrame([(1, "only one row")], kind)).collect(), [(1, "only one row")])
    check(audit_edits(spark.createDataFrame([(2, "b c d"), (1, "x\ny")], kind)).collect(), [(1, "x\ny"), (2, "b c d")])


def test_order_insertion_and_deletion():
    rng = random.Random(7)
    lines = [" ".join(rng.choices("abcdefghijkl", k=rng.randrange(12))) for _ in range(40)]
    whole = Fingerprint("\n".join(lines))
    shuffled = rng.sample(lines, len(lines))
    assert str(Fingerprint("\n".join(shuffled))) == str(whole)
    grown = Fingerprint("\n".join(shuffled[:25]))
    assert str(grown) != str(whole)
    assert str(grown.insert(*shuffled[25:])) == str(whole)
    assert str(Fingerprint.read(str(whole)).delete(*lines[10:])) == str(Fingerprint("\n".join(lines[:10])))
    assert str(Fingerprint("a\na")) != str(Fingerprint("a")) != str(Fingerprint())


def test_likeness_follows_what_is_shared():
    rng = random.Random(11)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))
    a, b = [line() for _ in range(60)], [line() for _ in range(60)]
    for share in (0, 0.25, 0.5, 0.75, 1):
        mixed = a[: int(60 * share)] + b[int(60 * share) :]
        assert Fingerprint("\n".join(a)).likeness(Fingerprint("\n".join(mixed))) == pytest.approx(share, abs=0.2)


def test_windows_of_words_change_nothing(monkeypatch):
    text = "\n".join(" ".join(f"w{i * j}" for j in range(i % 9)) for i in range(200))
    want = str(Fingerprint(text))
    for window in (1, 2, 7, 100):
        monkeypatch.setattr(fingerprints, "WINDOW", window)
        assert str(Fingerprint(text)) == want


def test_fingerprints_of_a_table(spark):
    rows = text_fingerprints(spark.createDataFrame([(1, "a b\nc"), (2, "c\na b"), (3, None), (4, "")], "doc_id long, text string")).collect()
    of = {r.doc_id: r.fingerprint for r in rows}
    assert of[1] == of[2] == str(Fingerprint("a b\nc")) and of[3] == of[4] != of[1]
