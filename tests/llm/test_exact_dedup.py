import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.llm import exact_dedup as D

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(4000))


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, LONG), (4, LONG.replace(" ", "\n")), (8, LONG + "x"), (3, "a b"), (None, "a b"), (None, "alone"), (11, "é ß"), (12, "x" * 9000), (13, "x" * 9000), (14, "x" * 8999)]


def run(docs, **kw):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in D.exact_dedup(docs, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    assert run(spark.createDataFrame(ROWS, "doc_id long, text string")) == brute(ROWS)


def test_chunks_of_equal_hash_are_told_apart(spark):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, LONG), (5, LONG.replace("word7 ", "word8 ")), (6, LONG), (7, None)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), chunk_hash=lambda c: F.length(c).cast("long")) == brute(rows)


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x", "k", 5), (2, "x", "k", 6)], "doc_id long, text string, keep_id string, recipe int")
    assert [r.kept for r in D.exact_dedup(docs).orderBy("doc_id").collect()] == [True, False]
    assert D.drop_copies(docs).columns == docs.columns
    assert D.drop_copies(docs).count() == 1
    assert D.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_hold_all_text(spark):
    row = spark.createDataFrame([(LONG,)], "t string").select(D.chunks_of(F.col("t")).alias("c")).first()
    assert "".join(row.c) == LONG and len(row.c) > 10 and max(map(len, row.c)) <= D.LONGEST
    moved = spark.createDataFrame([("inserted here " + LONG,)], "t string").select(D.chunks_of(F.col("t")).alias("c")).first()
    assert len(set(row.c) & set(moved.c)) >= len(row.c) - 4  # cuts find each other again after an insertion


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "कखगघचछजझटठडढतथदधनपफबभम", "กขคงจฉชซญดตถทธนบปผพฟม", "ابتثجحخدذرزسشصضطظعغ"])
def test_cuts_find_each_other_in_every_alphabet(spark, letters):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(6000))
    before, after = (set(r.c) for r in spark.createDataFrame([(text,), (letters[:9] + text,)], "t string").select(D.chunks_of(F.col("t")).alias("c")).collect())
    assert len(before) > 20 and len(before & after) >= len(before) - 12
