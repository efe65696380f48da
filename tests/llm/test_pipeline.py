"""The pipeline and the queries without SQL against plain Python, on the smallest tables."""

import hashlib
import re
import struct
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import decontaminate, queries, toxicity
from rankloom.llm.storage import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def toxic_ids(spark, docs):
    model = toxicity.learn_toxicity(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    grammar = toxicity.Grammar(model["stems"])
    score = lambda t: sum(w * x for w, x in zip(model["weights"], [*grammar.features(t or ""), 1.0], strict=True))
    return {i for i, t in docs.items() if score(t) >= 0}


def groups_of_near_copies(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    ids = sorted(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_pipeline_matches_plain_python(spark, docs, library):
    rows = corpus_pipeline.run(spark, SF).collect()
    left = {i: t for i, t in docs.items() if i not in toxic_ids(spark, docs)}
    seen: dict[str, int] = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in seen.values()}
    root = groups_of_near_copies(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    items = [decontaminate.words_of(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    found = lambda t: any(decontaminate.align(w, t)[0] >= decontaminate.LEAST_SCORE for w in items if len(w) >= decontaminate.LEAST_WORDS)
    left = {i: t for i, t in left.items() if not found(decontaminate.words_of(t))}
    assert {r.doc_id for r in rows} == set(left) and len(rows) == len(left)
    for r in rows:
        ids = library.encode(left[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)


def test_stages_keep_the_columns_of_documents(spark):
    table = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table.limit(0), SF)
        assert out.columns == table.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table.limit(0), SF).count() == 0


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [("a", 5, None, 0.5), ("b", None, "plain words of a text", 0.1), ("c", 7, "", 0.2), ("d", 8, long, 0.3), ("d", 8, long, 0.3), ("e", 9, long + " tail", None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "component string, doc_id long, text string, score double")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    every = sorted(((i, t) for _, i, t, _ in rows), key=str)
    assert left["toxicity"] == left["decontamination"] == every
    assert [i for i, _ in left["exact_dedup"]] == [5, 8, 8, 9, None]
    assert [i for i, _ in left["ngram_jaccard"]] == [5, 7, 8, 8, None, None]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_bpe_query(spark, docs, library):
    for r in queries.bpe_round_trip(spark, SF).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shards_query(spark, docs):
    rows = queries.shards(spark, SF).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_leaks_query(spark, docs):
    items = {r.item_id: decontaminate.words_of(r.text) for r in read_table(spark, SF, "benchmark").collect()}
    want = {(i, k) for i, t in docs.items() for k, w in items.items() if len(w) >= decontaminate.LEAST_WORDS and decontaminate.align(w, decontaminate.words_of(t))[0] >= decontaminate.LEAST_SCORE}
    assert {(r.doc_id, r.item_id) for r in queries.benchmark_leaks(spark, SF).collect()} == want


def test_secret_digests(spark, docs):
    for r in queries.secret_spans(spark, SF).collect():
        kinds = ["assign", "access", "hex"]
        base = [x for x in r.spans.split(",") if x.split(":")[0] in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k + ":") for x in base) for k in kinds]


@pytest.mark.parametrize("name", ["op2_toxic_documents", "op4_quality_scores"])
def test_scores(spark, docs, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if name.startswith("op2") else 0.3))
