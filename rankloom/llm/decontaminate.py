"""Benchmark decontamination: rare seeds join documents to test items, and Smith-Waterman alignment scores what they join.

A seed is an ordered pair of word beginnings that stand next to each other or one word apart. Wherever an alignment scores enough to
count, many of its matched words follow each other that closely, in the item and in the text; so a document that holds none of an
item's rarest seeds can't contain the item, however it was edited, and no leak is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import MOST_SENT_IDS, materialize, sent_if_few
from .workers import releasing

#: Edited copies of shorter items can't be told from chance; they are matched as whole sequences of words.
LEAST_WORDS = 8
#: Scores: 2 for an equal word, 1 for two words with the same beginning, -1 for others and for gaps, in parts of the item's perfect score.
LEAST_SCORE = 0.5
#: Letters that make the beginning of a word.
BEGINNING = 4
#: Words of a common run, which are counted for a report only.
RUN_WORDS = 4
#: UTF-8 bytes of items that are sent to the tasks at once; larger benchmarks are matched block by block.
BLOCK_BYTES = 16_000_000
#: Rare places of an item that have to be hit before all its places are counted.
RARE_HITS = 6
#: Slots for each rare seed, and in all at least, of the filter that seeds go through first; words of texts that are looked up together.
SEED_SLOTS, LEAST_SLOTS, SLICE_WORDS = 16, 1 << 20, 50_000

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def runs(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + RUN_WORDS]) for i in range(len(words) - RUN_WORDS + 1)}


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Finder:
    """Finds the stretches of a text where one of some items may lie, and aligns them. No alignment that reaches the least score is missed.

    An alignment of p matched words (2 points at most each) and q others (-1 each) that has S points or more has q <= 2 p - S. Of the p - 1
    steps from a matched word to the next, at most q / 2 pass two others or more; so S / 2 - 1 steps at least lead to a word that is next or
    next but one, both in the item and in the text: that many places of the item are hit by a seed. An item has n - 1 places, so of its
    n - S / 2 + RARE_HITS rarest ones RARE_HITS at least are hit. Those are looked up first, for many texts at once; then all places of
    the items found are counted, and a running sum bounds the score.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least_score: float) -> None:
        if least_score * LEAST_WORDS <= 1:
            raise ValueError(f"scores of {1 / LEAST_WORDS} or less leave items without seeds")
        self.items = [x for x in items if len(x[1]) >= LEAST_WORDS]
        self.short: dict[str, list[tuple[int, list[str]]]] = {}
        for x in items:
            if 0 < len(x[1]) < LEAST_WORDS:
                self.short.setdefault(x[1][0], []).append(x)
        size = np.array([len(w) for _, w in self.items], np.int64)
        self.least = 2 * size * least_score - 1e-9
        self.hits = np.maximum(np.ceil(self.least / 2 - 1 - 1e-9), 1).astype(np.int64)
        #: n words with n - least / 2 of them lost, and as many words of the text between as lose the rest of the points
        self.span = np.maximum(size, np.floor(3 * size - self.least)).astype(np.int64)
        self.begin_ids: dict[str, int] = {}
        self.word_ids: dict[str, int] = {}
        for _, words in self.items:
            for x in words:
                self.begin_ids.setdefault(x[:BEGINNING], len(self.begin_ids) + 1)
                self.word_ids.setdefault(x, len(self.word_ids) + 1)
        self.base = len(self.begin_ids) + 1
        self.bags = [(Counter(w), Counter(x[:BEGINNING] for x in w)) for _, w in self.items]
        self.rare_hits = np.minimum(self.hits, RARE_HITS)
        self._seed(size)

    def _seed(self, size: np.ndarray) -> None:
        seeds = [np.empty((0, 2), np.int64)]
        for _, words in self.items:
            b = np.array([self.begin_ids[x[:BEGINNING]] for x in words], np.int64)
            near = b[:-1] * self.base + b[1:]
            seeds.append(np.stack([near, np.append(b[:-2] * self.base + b[2:], near[-1])], axis=1))
        #: the two seeds of each place of all items, and where an item's begin
        self.seeds = np.concatenate(seeds)
        self.places = np.r_[0, np.cumsum(size - 1)]
        item = np.repeat(np.arange(len(size)), size - 1)
        # rare: few items have the seed
        pair = np.unique(np.stack([self.seeds.ravel(), np.repeat(item, 2)], axis=1), axis=0)
        known, n_items = np.unique(pair[:, 0], return_counts=True)
        common = n_items[np.searchsorted(known, self.seeds)].max(axis=1) if len(known) else np.empty(0, np.int64)
        by_rarity = np.lexsort((common, item))
        rank = np.arange(len(item)) - self.places[item]
        rare = np.sort(by_rarity[rank < (size - 1 - self.hits + self.rare_hits)[item]])
        seed, place = self.seeds[rare].ravel(), np.repeat(rare, 2)
        order = np.argsort(seed, kind="stable")
        seed, place = seed[order], place[order]
        #: the rare seeds in order, and the places of each
        first = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]][: len(seed)])
        self.rare, self.rare_begin, self.rare_places, self.item_of = seed[first], np.append(first, len(seed)), place, item
        bits = max(LEAST_SLOTS, SEED_SLOTS * len(self.rare)).bit_length() - 1
        self.shift = np.uint64(64 - bits)
        self.filter, self.seen = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        self.filter[self.slots(self.rare)] = True

    def slots(self, seeds: np.ndarray) -> np.ndarray:
        return (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rarely_hit(self, begins: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """(place, items) of the texts that hit enough rare places of some items."""
        gap = np.zeros(2, np.int64)
        joined = np.concatenate([x for text in begins for x in (text, gap)])
        text_end = np.cumsum([len(x) + 2 for x in begins])
        hits = []
        for apart in (1, 2):
            seeds = joined[:-apart] * self.base + joined[apart:]
            at = np.flatnonzero(self.filter[self.slots(seeds)])
            seeds = seeds[at]
            k = np.searchsorted(self.rare, seeds)
            k[k == len(self.rare)] = 0
            same = self.rare[k] == seeds
            k, text = k[same], np.searchsorted(text_end, at[same], side="right")
            begin, end = self.rare_begin[k], self.rare_begin[k + 1]
            hits.append(np.repeat(text, end - begin) * len(self.item_of) + self.rare_places[_ranges(begin, end)])
        text, place = np.divmod(np.unique(np.concatenate(hits)), len(self.item_of))
        pair, n = np.unique(text * len(self.items) + self.item_of[place], return_counts=True)
        text, item = np.divmod(pair, len(self.items))
        enough = n >= self.rare_hits[item]
        text, item = text[enough], item[enough]
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
        return [(int(text[a]), item[a:b]) for a, b in pairwise([*first.tolist(), len(text)])]

    def often_hit(self, begins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Those of the items of whose places enough are hit."""
        slots = np.concatenate([self.slots(begins[:-1] * self.base + begins[1:]), self.slots(begins[:-2] * self.base + begins[2:])])
        begin, end = self.places[items], self.places[items + 1]
        self.seen[slots] = True
        hit = self.seen[self.slots(self.seeds[_ranges(begin, end)])].any(axis=1)
        self.seen[slots] = False
        return items[np.add.reduceat(hit, np.cumsum(end - begin) - (end - begin), dtype=np.int64) >= self.hits[items]]

    def stretches(self, words: list[str], begins: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to) of the words before the ends of possible alignments; overlapping ones are joined.

        A word of the text adds at most 2 to an alignment with an item that has it, 1 with one that has its beginning, and costs 1
        otherwise. So where an alignment ends, the best sum of these figures over the words before is its score or more.
        """
        items = self.often_hit(begins, items)
        if not len(items):
            return
        name = self.word_ids.get
        numbers = np.array([name(w, 0) for w in words])
        for i in items.tolist():
            own, own_begins = self.bags[i]
            has = lambda found, names, bag: np.isin(found, np.array([names[x] for x in bag]))
            total = np.cumsum(np.where(has(numbers, self.word_ids, own), 2, np.where(has(begins, self.begin_ids, own_begins), 1, -1)))
            total -= np.minimum(np.minimum.accumulate(total), 0)
            end = np.flatnonzero(total >= self.least[i]) + 1
            if len(end):
                start = np.maximum(end - self.span[i], 0)
                new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                yield from ((i, a, b) for a, b in zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))

    def leaks(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(place of the text, item id, score, start, end, number of common runs of RUN_WORDS words)."""
        if self.short:
            for k, words in enumerate(texts):
                if not self.short.keys().isdisjoint(words):
                    for j, w in enumerate(words):
                        for name, item in self.short.get(w, ()):
                            if words[j : j + len(item)] == item:
                                yield k, name, 1.0, j, j + len(item), len(runs(item))
        if not self.items or not texts:
            return
        begin = self.begin_ids.get
        begins = [np.array([begin(w[:BEGINNING], 0) for w in words], np.int64) for words in texts]
        for k, items in self.rarely_hit(begins):
            for i, lo, hi in self.stretches(texts[k], begins[k], items):
                name, item = self.items[i]
                window = texts[k][lo:hi]
                # a pair of equal words counts 2, another pair 1: no alignment has more pairs than the two bags of words have in common
                own, own_begins = self.bags[i]
                if (own & Counter(window)).total() + (own_begins & Counter(w[:BEGINNING] for w in window)).total() < self.least[i]:
                    continue
                value, start, end = align(item, window)
                if value * 2 * len(item) >= self.least[i]:
                    yield k, name, value, lo + start, lo + end, len(runs(item) & runs(window[start:end]))

    def slices(self, texts: Iterator[str | None]) -> Iterator[list[list[str]]]:
        """The words of the texts, so many texts at a time that they have about SLICE_WORDS words."""
        held, n = [], 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n > SLICE_WORDS:
                yield held
                held, n = [], 0
        if held:
            yield held


def align(item: list[str], window: list[str]) -> tuple[float, int, int]:
    """Smith-Waterman: (share of the item's perfect score, start, end) of the best local alignment, in words of the window.

    A row of the matrix at a time; gaps within a row are a running maximum.
    """
    if not item or not window:
        return 0.0, 0, 0
    names: dict[str, int] = {}
    number = lambda ws: np.array([names.setdefault(w, len(names)) for w in ws])
    a, b, begins_a, begins_b = number(item), number(window), number(["^" + w[:BEGINNING] for w in item]), number(["^" + w[:BEGINNING] for w in window])
    steps = np.arange(1, len(b) + 1)
    row, start = np.zeros(len(b) + 1), np.arange(len(b) + 1)
    best = (0.0, 0, 0)
    for i in range(len(a)):
        gain = np.where(b == a[i], 2.0, np.where(begins_b == begins_a[i], 1.0, -1.0))
        diagonal, above = row[:-1] + gain, row[1:] - 1.0
        here = np.maximum(np.maximum(diagonal, above), 0.0)
        begin = np.where(here <= 0, steps, np.where(diagonal >= above, start[:-1], start[1:]))
        lifted = here + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(len(b)), 0))
        new = np.zeros(len(b) + 1)
        new[1:] = top - steps
        new_start = np.arange(len(b) + 1)
        new_start[1:] = begin[source]
        row, start = new, new_start
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), int(start[j]), j)
    return best[0] / (2 * len(a)), best[1], best[2]


LEAKS = "doc_id long, item_id long, score double, start_word int, end_word int, n_seeds int"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_seeds", pa.int32())])


def _aligned(docs: DataFrame, sent: Broadcast, least_score: float) -> DataFrame:
    """A row for each stretch of a document whose alignment with an item, of those sent (id, words), reaches least_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value, least_score)
        for batch in batches:
            ids, rows, done = batch.column(0).to_pylist(), [], 0
            for texts in finder.slices(batch.column(1).to_pylist()):
                rows += [(ids[done + k], *leak) for k, *leak in finder.leaks(texts)]
                done += len(texts)
            yield pa.RecordBatch.from_pylist([dict(zip(_LEAKS.names, r, strict=True)) for r in rows], _LEAKS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), LEAKS)


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of about BLOCK_BYTES, dealt by the hash of their ids."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return [benchmark] if n <= 1 else [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document and test item that it contains: doc_id, item_id, score, start_word, end_word, n_seeds.

    score is the alignment's share of the item's perfect score, for the best place; least_score or more is a leak. Every such document
    is found, however many others have the same passage. n_seeds counts the four-word runs that the place has in common with the item.
    Words are runs of letters, digits and underscores in lower case. Null and empty texts contain nothing; items of fewer than
    LEAST_WORDS words are leaks where all their words follow each other; items without words, null ones too, are not looked for. Rows
    that repeat an id give its best place once; of items that repeat an id, the best counts. Ids are cast to long: text that is no number
    fails. Of equal scores the first place counts. Empty tables give no rows; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    out, blocks = None, _blocks(items)
    for block in blocks:
        listed = [(r["item_id"], r["text"]) for r in block.distinct().collect()]
        sent = docs.sparkSession.sparkContext.broadcast([(i, words_of(t)) for i, t in listed])
        found = _aligned(docs, sent, least_score)
        if len(blocks) > 1:  # one block at a time is held, whatever the benchmark's size
            found = materialize(found, "aligned")
            sent.destroy()
        out = found if out is None else out.union(found)
    place = F.max_by(F.struct("start_word", "end_word", "n_seeds"), F.struct("score", -F.col("start_word"))).alias("place")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), place).select("doc_id", "item_id", "score", "place.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain a test item. The few ids are written first, so that documents needn't be shuffled to lose them."""
    dropped = materialize(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(sent_if_few(dropped, MOST_SENT_IDS), "doc_id", "left_anti").select(*docs.columns)
