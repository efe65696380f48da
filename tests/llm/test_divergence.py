"""Divergence of sources against exact fractions in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from rankloom.llm import divergence
from rankloom.llm.divergence import audit_sources, shares, term_pieces

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(docs, least=10):
    counts, docs_of, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(UPPER))
        counts[lang, source].update(terms)
        docs_of[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, names in groups.items():
        kept = sorted(t for t, n in docs_of[lang].items() if n >= least)

        def of(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        q, p = of(sum((counts[lang, s] for s in names), Counter())), {s: of(counts[lang, s]) for s in names}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, 10)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows)]
    return sorted(out)


def ours(docs, **how):
    return sorted(tuple(r) for r in audit_sources(docs, **how).collect())


def test_documents_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ours(docs) == plain([tuple(r) for r in docs.select("text", "lang", "source").collect()])


def test_chunks_and_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abé", k=rng.randrange(1, 6))) for _ in range(60)] + ["Z\U0001f600", "ÀB"]
    rows = [(rng.choice([" ", "1"]).join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), f"s{rng.randrange(9)}") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = plain(rows)
    assert ours(docs) == want
    for name, value in (("CHUNK_TERMS", 5), ("CHUNK_ROWS", 7), ("BLOCK", 2), ("MOST_HELD", 10), ("PIECE", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert ours(docs) == want


def test_nulls_ties_empty_groups_and_clashing_columns(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), ("x y", "en", None), ("x y", "en", "c"), ("x y", "en", "c"), ("no kept term", "de", "a"), (None, "de", "b"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n int, term string, chunk int")
    assert ours(docs, least_docs=3) == plain(rows, 3)
    assert audit_sources(docs.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Abc déf, " * 1000 + "x" * 5000).encode()
    whole = list(term_pieces(text.lower()))
    monkeypatch.setattr(divergence, "PIECE", 10)
    assert sum(term_pieces(text.lower()), []) == sum(whole, []) and len(list(term_pieces(text.lower()))) > 100


def test_shares_are_exact():
    rng = random.Random(1)
    for total in (3, 10**6 + 7, 10**12 + 39, 8 * 10**15 + 1):
        counts = [0, 1, total - 2, *(rng.randrange(total - 1) for _ in range(50))]
        assert shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
