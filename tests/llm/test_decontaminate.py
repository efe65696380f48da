import random

import pytest

from rankloom.llm import decontaminate as D

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghijklm", k=6)) for _ in range(500)]
pick = lambda n: RNG.choices(WORDS, k=n)
ITEMS = [(i, " ".join(pick(30))) for i in range(6)] + [(6, "too short"), (7, None)]


def edited(text, every):
    return " ".join(RNG.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(text.split()))


def plain_align(item, window):
    best, h = 0.0, {}
    for i, a in enumerate(item):
        for j, b in enumerate(window):
            gain = 2 if a == b else 1 if a[:4] == b[:4] else -1
            h[i, j] = max(0, h.get((i - 1, j - 1), 0) + gain, h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
            best = max(best, h[i, j])
    return best / (2 * len(item))


def test_alignment_matches_the_plain_matrix():
    for _ in range(30):
        item, window = pick(12), pick(40)
        window[5:14] = item[1:5] + pick(1) + item[5:9]
        score, start, end = D.align(item, window)
        assert score == pytest.approx(plain_align(item, window))
        assert plain_align(item, window[start:end]) == pytest.approx(score)
    assert D.align([], ["a"]) == (0.0, 0, 0)


def test_exact_edited_and_clean_documents(spark):
    docs = [(1, " ".join(pick(200)) + " " + ITEMS[0][1].upper() + ". " + " ".join(pick(50))), (2, edited(ITEMS[1][1], 7)), (3, " ".join(pick(400))), (4, None), (5, ""), (2, edited(ITEMS[1][1], 9)), (None, ITEMS[2][1]), (6, " ".join(ITEMS[3][1].split()[:5]))]
    rows = D.find_leaks(spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert set(got) == {(1, 0), (2, 1), (None, 2)} and len(rows) == 3
    assert got[1, 0].score == 1.0 and (got[1, 0].start_word, got[1, 0].end_word) == (200, 230)
    assert 0.6 < got[2, 1].score < 1.0


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(pick(20)) + " " + t) for i, t in ITEMS[:6]], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, D.find_leaks(docs, items).collect())) == whole and len(whole) == 6


def test_common_passage_is_still_found(spark):
    docs = spark.createDataFrame([(i, " ".join(pick(10)) + " " + ITEMS[0][1]) for i in range(40)], "doc_id long, text string")
    assert D.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 40


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_leaks(docs.limit(0), items).count() == 0
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.drop_leaks(docs, items).columns == docs.columns


def test_common_edited_passage_is_still_found(spark):
    """A copy that keeps two runs of four words, in every document."""
    item = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 b0 b1 b2 b3 b4"
    copy = " ".join("x" if i in (2, 7, 12) else w for i, w in enumerate(item.split()))
    docs = spark.createDataFrame([(i, " ".join(pick(10)) + " " + copy) for i in range(40)], "doc_id long, text string")
    rows = D.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(rows) == 40 and all(r.score == pytest.approx((12 * 2 - 3) / 30) for r in rows)


def test_close_edits_match_brute_force(spark):
    docs = [(10 * i + k, " ".join(pick(30)) + " " + edited(ITEMS[i][1], k) + " " + " ".join(pick(30))) for i in range(6) for k in (2, 3, 4, 5)]
    rows = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    want = {(d, i): s for d, t in docs for i, item in ITEMS[:6] if (s := plain_align(item.split(), t.split())) >= D.LEAST_SCORE}
    assert {(r.doc_id, r.item_id): r.score for r in rows} == pytest.approx(want)
    assert {(10 * i + 4, i) for i in range(6)} <= want.keys()


def test_short_items_match_as_whole_sequences(spark):
    docs = spark.createDataFrame([(1, "this is Too short, they said"), (2, "too very short"), (3, "too shortened"), (4, "too short too short")], "doc_id long, text string")
    rows = D.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in rows} == {(1, 6, 1.0, 2, 4), (4, 6, 1.0, 0, 2)}
