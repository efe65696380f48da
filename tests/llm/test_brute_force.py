"""Whole queries that SQL can't express, computed anew in plain Python on the smallest tables."""

import math
import zlib
from collections import Counter

import pytest
import regex
import xxhash
from rankloom.llm import quality, queries, secrets, sharding, toxicity
from rankloom.llm.storage import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}


# --- op2: each transducer is run by itself, over every clause of the text --------------------------------------------------------------


def clause_weight(words, stems):
    states, total, kinds = ["0"] * len(toxicity.GRAMMAR), 0.0, Counter()
    for word in words:
        known = [s for s in stems if (word == s[:-1] if s.endswith("$") else word.startswith(s))]
        whole = [s for s in known if s.endswith("$")]
        stem = stems[whole[0]] if whole else stems[max(known, key=len)] if known else 0.0
        symbol = "I" if stem else toxicity.WORD_CLASSES.get(word)
        if symbol is None:
            continue
        bonus = 0.0
        for i, machine in enumerate(toxicity.GRAMMAR):
            states[i], symbol, weight = machine.get((states[i], symbol), (states[i], symbol, 0.0))
            bonus += weight
        if symbol[0] in "IK":
            total += (stem or 1.0) * max(0.1, bonus)
            kinds["IT" if symbol.startswith("IT") else symbol[0]] += 1
            kinds.update(m for m in "nr" if m in symbol)
    return total, kinds


def toxic_score(text, model):
    best = total = clauses = 0
    kinds = Counter()
    for clause in regex.split(r"[.!?;:\n]+", (text or "").lower()):
        weight, found = clause_weight(regex.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause), model["stems"])
        if weight:
            best, total, clauses = max(best, weight), total + weight, clauses + 1
            kinds += found
    x = [float(total > 0), math.log1p(best), math.log1p(total), math.log1p(clauses), *(math.log1p(kinds[k]) for k in toxicity.KINDS), 1.0]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(model["weights"], x, strict=True))))))


def test_toxic_scores(spark, docs):
    model = toxicity.learn_toxicity(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    rows = queries.toxic_documents(spark, SF).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({i: toxic_score(t, model) for i, t in docs.items()}, abs=1e-6)
    assert model["stems"] and max(r.score for r in rows) > 0.5


def test_the_lexicon_has_no_cap():
    """The greedy cover by a queue gives what trying all stems at every step gives."""
    import random

    import numpy as np

    rng = random.Random(3)
    documents_of = {f"stem{i:04}": np.array(sorted(rng.sample(range(900), rng.randint(3, 12)))) for i in range(700)}
    toxic = np.array([rng.random() < 0.8 for _ in range(900)])
    got = toxicity.choose_stems(documents_of, toxic)
    open_, left, want = toxic.copy(), dict(documents_of), []
    bad = {s: int(toxic[d].sum()) for s, d in documents_of.items()}
    for s in sorted((s for s, d in left.items() if bad[s] >= toxicity.SURE_DOCS and bad[s] / len(d) >= toxicity.SURE_SHARE), key=lambda s: (-bad[s], -len(s), s)):
        want.append(s)
        open_[left.pop(s)] = False
    while left:
        s = max(left, key=lambda s: (int(open_[left[s]].sum()), bad[s] / len(left[s]), len(s), s))
        if open_[left[s]].sum() < toxicity.LEAST_DOCS:
            break
        want.append(s)
        open_[left.pop(s)] = False
    assert list(got) == want and len(want) > 100


# --- op4: the features counted anew ----------------------------------------------------------------------------------------------------


def quality_features(text):
    t = text or ""
    words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", t) if w]
    chars = max(len(t), 1)
    share = lambda pattern: sum(map(len, regex.findall(pattern, t))) / chars
    distinct, size = len(set(words)) / max(len(words), 1), math.log1p(len(words))
    marks, upper = share(r"[^\p{L}\p{N} \t\n\x0b\f\r.,'-]+"), share(r"\p{Lu}+")
    return [size, min(len(t) / max(len(words), 1), 20.0), distinct, max(0.0, 4.2 - 0.45 * size - 4 * distinct), marks, math.sqrt(marks), upper, math.sqrt(upper), share("[0-9]+"), share("[.,]+"), float(len(words) < 8)]


def test_quality_scores(spark, docs):
    model = quality.learn_quality(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    rows = queries.quality_scores(spark, SF).collect()
    raw = {i: float(sum(w * x for w, x in zip(model["weights"], quality_features(t), strict=True)) + model["offset"] - model["threshold"] + math.log(3 / 7)) for i, t in docs.items()}
    assert {r.doc_id: r.score for r in rows} == pytest.approx({i: 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for i, s in raw.items()}, abs=1e-6)


def test_pair_weights_are_the_minimum_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    good = (rng.random(400) < 0.6).astype(int)
    x = rng.normal(size=(400, 3)) + good[:, None] * [1.0, -0.5, 0.0]
    model = quality.fit_pairs(x, good, 0.4)
    weights = np.asarray(model["weights"])
    assert weights[0] > 0.5 and weights[1] < -0.2 and abs(weights[2]) < 0.4
    assert ((x @ weights + model["offset"]) < model["threshold"]).mean() == pytest.approx(0.4, abs=0.01)


# --- op5: every span found anew --------------------------------------------------------------------------------------------------------


def entropic(s):
    if not regex.search(secrets.MIXED, s) or any(regex.search(p, s) for p in secrets.ALLOWED):
        return False
    if sum(bool(regex.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
        return False
    cls = next(c for c in secrets.CLASSES if set(s) <= set(c.alphabet))
    n = min(len(s), cls.window)
    return any(-sum(v / n * math.log2(v / n) for v in Counter(s[i : i + n]).values()) >= cls.bits - 1e-12 for i in range(len(s) - n + 1))


def secret_spans(text):
    text = text or ""
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = [(m.start(), 0, m.end()) for m in regex.finditer(assign, text) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = [(m.start(), 3, m.end()) for m in regex.finditer("[A-Za-z0-9+/_=-]{20,}", text) if entropic(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base)]
    return sorted(base + more)


def test_secret_spans(spark):
    """On the next larger tables, as the smallest hold no secrets."""
    larger = SF.replace("0.001", "0.01")
    rows, kinds = queries.secret_spans(spark, larger).collect(), secrets.KINDS
    texts = {r.doc_id: r.text for r in read_table(spark, larger, "documents").select("doc_id", "text").collect()}
    assert {r.doc_id: r.spans for r in rows} == {i: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in secret_spans(t)) for i, t in texts.items()}
    assert sum(r.n_assign + r.n_hex for r in rows) > 0


def test_many_spans_and_long_candidates(spark):
    """More matches than a block of running() holds, base and entropy spans that touch, and a candidate of 200,000 characters."""
    import random
    import time

    rng = random.Random(8)
    key = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    parts = [rng.choice([f"token={key(24)}", key(30), "".join(rng.choices("0123456789abcdef", k=40)), "plain words é", f"{key(25)} secret: {key(9)}"]) for _ in range(700)]
    texts = [" ".join(parts), key(200_000), "a" * 100_000, " ".join([key(22)] * 300)]
    started = time.time()
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert time.time() - started < 60
    for r, text in zip(rows, texts, strict=True):
        assert [(s.start, s.kind, s.end) for s in r.spans] == secret_spans(text)


# --- op7: the ring walked key by key ---------------------------------------------------------------------------------------------------


def walked(rows, n_shards, virtual_nodes=128):
    nodes = {}
    for shard in range(n_shards):
        for i in range(virtual_nodes):
            at = zlib.crc32(f"shard-{shard}-node-{i}".encode()) % sharding.RING
            while at in nodes:
                at = (at + 1) % sharding.RING
            nodes[at] = shard
    places = sorted(nodes)
    hashed = []
    for doc, text in rows:
        h = xxhash.xxh64_intdigest("" if doc is None else str(doc), seed=42)
        h -= (h >> 63) << 64
        raw = (text or "").encode()
        arc = next((k for k, p in enumerate(places) if p >= h % sharding.RING), 0)
        hashed.append((arc, h, (doc is not None, doc or 0), zlib.crc32(raw), len(raw) + 1, doc))
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    used, out, over = [0] * n_shards, [], []

    def put(row, shard):
        out.append((row[5], row[4], row[3], shard, used[shard]))
        used[shard] += 1

    for row in sorted(hashed, key=lambda r: r[:5]):
        shard = nodes[places[row[0]]]
        if used[shard] < room[shard]:
            put(row, shard)
        else:
            over.append(row)
    for row in over:
        at = row[0]
        while used[nodes[places[at]]] >= room[nodes[places[at]]]:
            at = (at + 1) % len(places)
        put(row, nodes[places[at]])
    return sorted(out, key=str)


def test_shards(spark, docs):
    rows = queries.shards(spark, SF).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=str) == walked(list(docs.items()), queries.N_SHARDS)


@pytest.mark.parametrize("most", [50, 200_000])
def test_shards_of_hot_keys_in_any_order(spark, monkeypatch, most):
    """The same rows go to the same shards and slots, however the input is ordered and however finely the ring is cut."""
    import random

    monkeypatch.setattr(sharding, "ROWS_PER_PART", most)
    rows = [(7, "same")] * 300 + [(7, f"other {i}") for i in range(50)] + [(None, None)] * 150 + [(i, "t") for i in range(400)]
    want = walked(rows, 8)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = sharding.bounded_load_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == want
