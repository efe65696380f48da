"""Nulls, empty and very long texts, ties, repeated rows and clashing columns, for the operators whose own tests don't cover them."""

import random

import pytest
from pyspark.sql import functions as F
from rankloom.llm import bpe, chat_format, decontaminate, quality, queries, secrets, toxicity, url_filter
from tokenizers import Tokenizer

RNG = random.Random(9)
LONG = " ".join("".join(RNG.choices("abcdefghij", k=5)) for _ in range(60_000))
#: Columns that operators also use as names of their own.
CLASH = "doc_id long, text string, score double, spans string, label int, x string, ids string, component long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, None), (2, ""), (3, "a plain text of some words"), (3, "a plain text of some words"), (4, LONG), (None, "no id"), (5, "  \n\t ")]
    return spark.createDataFrame([(i, t, 0.5, "s", 1, "x", "i", 7) for i, t in texts], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (3, 1, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_scores_of_any_text(docs, labels):
    for model, score in ((quality.learn_quality(docs, labels), quality.score_quality), (toxicity.learn_toxicity(docs, labels), toxicity.score_toxicity)):
        rows = score(docs, model).collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 3}) == 1  # repeated rows
        empty = {r.doc_id: r.score for r in rows}
        assert empty[1] == empty[2]  # null counts as empty


def test_leaks_in_long_and_repeated_texts(spark, docs):
    words = LONG.split()
    item = " ".join(words[50_000:50_020])
    benchmark = spark.createDataFrame([(1, item, "b"), (1, item, "b"), (2, None, "b"), (3, "", "b"), (None, item, "b"), (4, "a plain text of some words", "b")], "item_id long, text string, score string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert set(rows) == {(4, 1), (3, 4)}
    assert (rows[4, 1].start_word, rows[4, 1].end_word, rows[4, 1].score) == (50_000, 50_020, 1.0)


def test_ties_take_the_first_place(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"{item} x {item} y {item}")], "doc_id long, text string")
    row = decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.score, row.start_word, row.end_word) == (1.0, 0, 10)


def test_secrets_of_any_text(docs):
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert len(rows) == 6 and all(not r.spans for r in rows.values())


def test_a_candidate_of_a_million_characters(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=1_000_000))
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in row.spans] == [(0, 1_000_000)]


def test_encoding_of_any_text(docs):
    library = Tokenizer.from_file(queries.TOKENIZER)
    rows = bpe.encode_documents(docs.select("*"), queries.TOKENIZER).collect()
    assert len(rows) == 7
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        assert list(memoryview(bytes(r.ids)).cast("I") if r.ids else []) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_one_huge_conversation_and_clashing_columns(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"turn {n} [INST]", "f") for n in range(20_000)] + [(2, 0, None, None, "f"), (2, 0, None, None, "f"), (None, 1, "user", "x", "f")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    read = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.turn_events(table))).collect()}
    assert len(read[1].texts) == 20_000 and read[1].texts[19_999] == "turn 19999 [INST]"
    assert read[2].texts == ["", ""] and read[None].texts == ["x"]
    assert read[1].loss == "".join(f"turn {n} [INST]" for n in range(1, 20_000, 2))


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.github.io", "github.io", "www.example.com:8080", "localhost", "", "a.b.c.d.org", "me.blogspot.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filter.suffix_of(F.col("h")).alias("s"), url_filter.domain_of(F.col("h")).alias("d")).collect()
    assert [(r.s, r.d) for r in rows] == [
        ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("github.io", "x.github.io"), ("github.io", "github.io"), ("com", "example.com"), ("localhost", "localhost"), ("", ""), ("org", "d.org"), ("blogspot.com", "me.blogspot.com")
    ]


def test_reputation_shrinks_through_its_levels(spark):
    """Hosts of a family share what is known of it; a host alone follows its suffix; all rows of a tie get the same verdict."""
    seen = [("a.bad.co.uk", 1)] * 40 + [("b.bad.co.uk", 1)] * 3 + [("good.co.uk", 0)] * 60 + [("x.org", 0)] * 50
    known = {r.host: r for r in url_filter.reputations(spark.createDataFrame(seen + [("new.bad.co.uk", None), ("new.org", None)], "host string, bad int")).collect()}
    assert known["new.bad.co.uk"].rate > known["good.co.uk"].rate and known["new.bad.co.uk"].rate > 0.3
    assert known["new.org"].rate < known["new.bad.co.uk"].rate
    pages = spark.createDataFrame([(1, "http://a.bad.co.uk/" + "p" * 100_000, 1, "r"), (1, "http://a.bad.co.uk/", 1, "r"), (2, None, None, "r")], "page_id long, url string, key long, rate string")
    rows = url_filter.judge_urls(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "key long, bad int")).collect()
    assert len(rows) == 3 and len({r.verdict for r in rows if r.page_id == 1}) == 1
    assert [(r.host, r.path) for r in rows if r.page_id == 2] == [("", "")]
