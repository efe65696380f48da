"""Toxicity by a weighted finite-state pattern grammar.

Small transducers, one each for insults, threats, targets, negation and reported speech, are composed into one machine over word classes.
It reads a clause and gives the weight of the patterns that it matched, so that "you are an X" counts for more than X alone, and a negated
or reported X can count for less. The insult lexicon, word stems with weights, is learned from labelled documents; so is how much each
kind of match counts for a document.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import is_trained_on, materialize
from .workers import releasing

#: Word classes by language; a word is looked up in lower case.
TARGETS = "you your yours they them he she these those people du ihr euch sie dich dir tu vous ils elles tú usted vosotros ellos ellas".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote quoted called according claims sagte schrieb laut dit écrit selon dijo escribió según".split()
THREATS = (
    "kill hurt destroy beat shoot stab murder strangle burn crush punch smash töten umbringen verletzen schlagen verprügeln erschießen erstechen vernichten "
    "tuer frapper abattre poignarder étrangler brûler massacrer matar golpear apuñalar disparar estrangular quemar masacrar"
).split()
WORD_CLASSES = {w: c for c, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("K", THREATS)) for w in words}

#: The fit's bound on labelled documents.
MOST_LABELLED = 12_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: A stem is kept if so many documents have it and so large a share of them is toxic; with fewer, if no earlier stem explains LEAST_DOCS of them.
SURE_DOCS, SURE_SHARE, LEAST_DOCS, LEAST_SHARE = 8, 0.9, 3, 0.75

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

# --- transducers: {(state, input class): (next state, output class, weight)}; classes that a state doesn't name pass unchanged -------------

#: "I" is an insult, "K" a threat; a negation, a report or a target within the clause marks what follows.
INSULT = {("0", "I"): ("0", "I", 1.0)}
THREAT = {("0", "K"): ("armed", "-", 0.0), ("armed", "T"): ("0", "K", 1.0), ("0", "T"): ("0", "T", 0.0), ("armed", "I"): ("0", "K", 1.0)}
TARGET = {("0", "T"): ("aimed", "-", 0.0), ("aimed", "I"): ("aimed", "IT", 0.5), ("0", "I"): ("0", "I", 0.0), ("aimed", "K"): ("aimed", "K", 0.0)}
NEGATION = {("0", "N"): ("denied", "-", 0.0), **{("denied", c): ("0", c + "n", -0.8) for c in ("I", "IT", "K")}}
REPORTED = {("0", "R"): ("told", "-", 0.0), **{("told", c): ("told", c + "r", -0.6) for c in ("I", "IT", "K", "In", "ITn", "Kn")}}
GRAMMAR = (INSULT, THREAT, TARGET, NEGATION, REPORTED)
#: Output classes that a matched clause is counted under.
KINDS = ("I", "IT", "K", "n", "r")


def compose(machines: tuple[dict, ...] = GRAMMAR) -> dict:
    """One machine over tuples of states: each transducer reads what the one before it writes; weights add up."""
    states = [sorted({s for (s, _) in m} | {to for to, _, _ in m.values()} | {"0"}) for m in machines]
    arcs = {}
    for at in product(*states):
        for cls in "ITNRK":
            symbol, weight, to = cls, 0.0, []
            for machine, state in zip(machines, at, strict=True):
                new, symbol, w = machine.get((state, symbol), (state, symbol, 0.0))
                weight += w
                to.append(new)
            arcs[at, cls] = (tuple(to), symbol, weight)
    return arcs


class Grammar:
    """Counts and weights of the matched clauses of a text. stems: weight of each insult stem; "word$" stands for the whole word."""

    def __init__(self, stems: dict[str, float]) -> None:
        import ahocorasick

        self.arcs, self.start = compose(), ("0",) * len(GRAMMAR)
        self.stems = stems
        self.find = ahocorasick.Automaton()
        for stem in stems:
            self.find.add_word(stem.removesuffix("$"), len(stem.removesuffix("$")))
        if stems:
            self.find.make_automaton()

    def weight(self, word: str) -> float:
        """Of the longest stem of the word, 0 if it has none."""
        if (w := self.stems.get(word + "$")) is not None:
            return w
        return next((self.stems[word[:n]] for n in range(min(len(word), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1) if word[:n] in self.stems), 0.0)

    def clause(self, words: list[str]) -> tuple[float, dict[str, int]]:
        state, total, kinds = self.start, 0.0, dict.fromkeys(KINDS, 0)
        for word in words:
            stem = self.weight(word)
            cls = "I" if stem else WORD_CLASSES.get(word)
            if cls is None:
                continue
            state, out, bonus = self.arcs[state, cls]
            if out[0] not in "IK":
                continue
            total += (stem or 1.0) * max(0.1, bonus)
            kinds["IT" if out.startswith("IT") else out[0]] += 1
            for mark in "nr":
                kinds[mark] += mark in out
        return total, kinds

    def features(self, text: str) -> list[float]:
        """Only clauses with an insult or a threat are read word by word; the automaton finds them in one pass."""
        lower = text.lower()
        starts: set[int] = set()
        if self.stems:
            for end, size in self.find.iter(lower):
                begin = end - size + 1
                if not (begin and lower[begin - 1].isalpha()):
                    starts.add(begin)
        for m in _THREAT.finditer(lower):
            starts.add(m.start())
        best, total, kinds, clauses, done = 0.0, 0.0, dict.fromkeys(KINDS, 0), 0, 0
        for begin in sorted(starts):
            if begin < done:
                continue
            left = max((lower.rfind(c, done, begin) for c in ".!?;:\n"), default=-1)
            end = CLAUSE_END.search(lower, begin)
            done = end.start() if end else len(lower)
            weight, found = self.clause(WORD.findall(lower, max(left + 1, 0), done))
            if weight:
                clauses, best, total = clauses + 1, max(best, weight), total + weight
                for k, n in found.items():
                    kinds[k] += n
        return [float(total > 0), math.log1p(best), math.log1p(total), math.log1p(clauses), *(math.log1p(kinds[k]) for k in KINDS)]


_THREAT = re.compile(r"\b(?:" + "|".join(THREATS) + r")\b")
N_FEATURES = 4 + len(KINDS)
#: The columns that hold them and the score.
FEATURES, SCORE = "_grammar_features", "_toxicity"


def _with_features(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """docs with FEATURES, the grammar's features of text. The lexicon is bounded by the labelled documents that it was learned from."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            x = [grammar.features(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names, FEATURES])

    schema = T.StructType([*docs.schema.fields, T.StructField(FEATURES, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(releasing(run), schema)


def _stem_documents(sample: DataFrame) -> DataFrame:
    """(stem, doc_no, toxic), once for each stem of a document: beginnings of its words, and whole words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    each = sample.select("doc_no", "label", F.explode(words).alias("word"))
    parts = F.array(F.concat("word", F.lit("$")), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEM_LENGTHS])
    return each.select("doc_no", "label", F.explode(parts).alias("stem")).filter("stem is not null").distinct()


def _reversed(stem: str) -> tuple[int, ...]:
    """Sorts stems from the last to the first."""
    return tuple(-ord(c) for c in stem) + (1,)


def choose_stems(documents_of: dict[str, np.ndarray], toxic: np.ndarray) -> dict[str, float]:
    """Stems that are sure on their own, then a greedy cover of the toxic documents that are left. Weights are log odds."""
    base = math.log((toxic.sum() + 0.5) / ((~toxic).sum() + 0.5))
    open_, stems = toxic.copy(), {}
    bad = {s: int(toxic[d].sum()) for s, d in documents_of.items()}

    def keep(stem: str) -> None:
        docs = documents_of[stem]
        stems[stem] = math.log((bad[stem] + 0.5) / (len(docs) - bad[stem] + 0.5)) - base
        open_[docs] = False

    # the widest stem first, among equals the longest that isn't a whole word; others of the same word add nothing to it
    sure = [s for s, d in documents_of.items() if bad[s] >= SURE_DOCS and bad[s] / len(d) >= SURE_SHARE]
    for stem in sorted(sure, key=lambda s: (-bad[s], s.endswith("$"), -len(s), s)):
        word = stem.removesuffix("$")
        if not any(word.startswith(k.removesuffix("$")) or k.startswith(word) for k in stems):
            keep(stem)
    # gains only fall as documents get explained: the best one whose gain is up to date is the best of all
    key = lambda s: (-int(open_[documents_of[s]].sum()), -bad[s] / len(documents_of[s]), -len(s), _reversed(s))
    queue = [(key(s), s) for s in documents_of if s not in stems]
    heapq.heapify(queue)
    while queue:
        stem = queue[0][1]
        now = key(stem)
        if now != queue[0][0]:
            heapq.heapreplace(queue, (now, stem))
            continue
        heapq.heappop(queue)
        if -now[0] < LEAST_DOCS:
            break
        keep(stem)
    return stems


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.01])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -4, 4)
    return w


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Fits on at most MOST_LABELLED labelled training rows, those with the smallest hashes of their ids."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & is_trained_on(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # near copies count once, so that a text's own words don't pass for insults: they agree in the least hashes of their long words
    long_words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,}"), F.lit(0)))
    shape = F.slice(F.array_sort(F.transform(long_words, lambda w: F.xxhash64(w))), 1, 3)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy(F.when(F.size(long_words) >= 3, shape).otherwise(F.array(F.xxhash64("text"))).alias("shape"), "label").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_no"))
    texts = materialize(texts, "labelled-texts")
    stems = _learn_stems(texts)
    rows = _with_features(texts.select("label", "text"), stems).drop("text").collect()  # MOST_LABELLED rows of features at most
    x, y = np.array([r[FEATURES] for r in rows], dtype=float).reshape(len(rows), N_FEATURES), np.array([r["label"] for r in rows], dtype=float)
    return {"stems": stems, "weights": _fit(x, y).tolist() if len(rows) else [0.0] * N_FEATURES + [-2.0]}


def _learn_stems(texts: DataFrame) -> dict[str, float]:
    pairs = _stem_documents(texts)
    counts = pairs.groupBy("stem").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).filter((F.col("bad") >= LEAST_DOCS) & (F.col("bad") / F.col("n") >= LEAST_SHARE))
    incidence = pairs.join(counts.select("stem"), "stem").groupBy("stem").agg(F.sort_array(F.collect_list("doc_no")).alias("docs")).collect()
    labelled = {r["doc_no"]: r["label"] for r in texts.select("doc_no", "label").collect()}  # MOST_LABELLED numbers at most
    order = {d: i for i, d in enumerate(sorted(labelled))}
    toxic = np.array([labelled[d] == 1 for d in order], dtype=bool)
    return choose_stems({r["stem"]: np.array([order[d] for d in r["docs"]]) for r in incidence}, toxic)


def _scored(docs: DataFrame, model: dict) -> DataFrame:
    s = F.lit(float(model["weights"][-1]))
    for i, weight in enumerate(model["weights"][:-1]):
        s = s + F.lit(float(weight)) * F.element_at(FEATURES, i + 1)
    return _with_features(docs, model["stems"]).withColumn(SCORE, 1 / (1 + F.exp(-F.least(F.greatest(s, F.lit(-30.0)), F.lit(30.0)))))


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 where score >= 0.5).

    Null and empty texts have no clause and get the score of a text without a match. Repeated rows get the same score each; an empty
    table gives no rows; without labelled rows nothing is predicted toxic. Other columns are ignored.
    """
    return _scored(docs.select("doc_id", "text"), model).select("doc_id", F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """docs, with all their columns, without the rows that are predicted toxic."""
    return _scored(docs, model).filter(F.col(SCORE) < 0.5).select(*docs.columns)
