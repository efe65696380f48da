"""How far the sources of a language differ in their words.

Terms become integers chunk by chunk: a chunk is a stretch of the kept terms of a language in UTF-8 order, and a term's place in it, found
by binary search, is its id. Counts of a chunk are dense vectors over these ids, one for each source, so that shares, divergences and
ties need no strings. Chunks are worked on apart; only sums and leading terms of a chunk leave it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize
from .workers import releasing

LEAST_DOCS, MOST_TERMS = 10, 10
#: Terms and rows after which a chunk ends, sources whose vectors are held against each other at once.
CHUNK_TERMS, CHUNK_ROWS, BLOCK = 4096, 500_000, 64
#: Distinct terms that a task counts before it hands them on, and bytes of a text read at once.
MOST_HELD, PIECE = 1_000_000, 1 << 20
#: So many copies of the table of sources meet the chunks of a language.
SALTS = 64

_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8, in lower case), a stretch at a time; no term is cut."""
    at = 0
    while at < len(text):
        m = _BREAK.search(text, min(at + PIECE, len(text)))
        end = m.start() if m else len(text)
        yield _TERM.findall(text, at, end)
        at = end + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, how often and in how many documents, for each stretch of a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])], schema=schema
                )
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            lang, source, text = (batch.column(c)[i].as_py() or "" for c in range(3))
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen, known = set(), len(n)
            for terms in term_pieces(text.encode().translate(_LOWER)):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - known
            if size > MOST_HELD:
                yield from flush()
                size = 0
    yield from flush()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, n) in order to chunks: sorted terms, sources, and for each count the places of its source and its term."""
    lang, terms, sources, counts, made = None, [], [], [], 0
    kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def close(upto: int) -> pa.RecordBatch:
        nonlocal made
        row_terms = np.empty(upto, object)
        row_terms[:] = terms[:upto]
        first = np.ones(upto, bool)
        first[1:] = row_terms[1:] != row_terms[:-1]
        kept = row_terms[first]  # sorted as the rows are
        names, of = np.unique(np.array(sources[:upto], object), return_inverse=True)
        out = [(TaskContext.get().partitionId() << 32) + made, lang, kept.tolist(), names.tolist(), of.tolist(), np.searchsorted(kept, row_terms).tolist(), counts[:upto]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], ["chunk", "lang", "terms", "sources", "source_no", "id", "n"])

    n_terms = 0
    for batch in batches:
        for l, term, source, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
            new = not terms or term != terms[-1]
            if terms and (l != lang or new and (n_terms >= CHUNK_TERMS or len(terms) >= CHUNK_ROWS)):
                yield close(len(terms))
                terms, sources, counts, n_terms, new = [], [], [], 0, True
            lang, n_terms = l, n_terms + new
            terms.append(term)
            sources.append(source)
            counts.append(n)
    if terms:
        yield close(len(terms))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), exactly, for totals under 9 * 10**15: three digits at a time."""
    rest, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are 10**9 + 1 at most, so squares fit."""
    return (p - q) * (p - q) // (p + q)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: for two sources the sum of differences, for a source the terms that lead over the language."""
    kinds = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())]
    for batch in batches:
        for i in range(batch.num_rows):
            lang, terms, names, of, ids, n, all_names, all_counts, n_terms, lang_count = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
            of, ids, n = (np.array(x, np.int64) for x in (of, ids, n))
            width, cells = len(terms), {}
            for k, name in enumerate(names):
                mine = of == k
                cells[name] = np.bincount(ids[mine], n[mine], width).astype(np.int64)  # below 2**53, so exact
            totals = {s: c + 2 * n_terms for s, c in zip(all_names, all_counts, strict=True)}
            q = shares(sum(cells.values()), lang_count + 2 * n_terms)
            rows = []
            for name, count in cells.items():
                at = np.flatnonzero(count)
                p = shares(count[at], totals[name])
                at, p = at[p > q[at]], p[p > q[at]]
                value = difference(p, q[at])
                rows += [(lang, name, "term", terms[at[k]], int(value[k])) for k in np.lexsort((at, -value))[:MOST_TERMS]]
            none = np.zeros(width, np.int64)
            vectors = lambda block: np.array([shares(cells.get(s, none), totals[s]) for s in block])
            blocks = [all_names[k : k + BLOCK] for k in range(0, len(all_names), BLOCK)]
            for a, left in enumerate(blocks):
                p = vectors(left)
                for b in range(a, len(blocks)):
                    r = p if b == a else vectors(blocks[b])
                    for k, s in enumerate(left):
                        from_ = k + 1 if b == a else 0
                        value = difference(p[k], r[from_:]).sum(axis=1)
                        rows += [(lang, s, "pair", t.encode(), int(v)) for t, v in zip(blocks[b][from_:], value, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds)) if rows else pa.RecordBatch.from_pylist([], pa.schema(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank from docs (text, lang, source).

    Part `pair`: how much a source differs from each other source of its language, over all terms that at least least_docs documents of
    the language have. Part `term`: the most_terms terms by which a source differs most from its language, of those that it has more
    often. Ties go to the smaller item in UTF-8 order. Nulls are empty texts; the empty language and source are as any other. Repeated
    rows count as documents of their own, a language without kept terms has pairs of value 0, an empty table gives no rows, other columns
    aren't read.
    """
    if most_terms > MOST_TERMS:
        raise ValueError(f"chunks keep {MOST_TERMS} terms of a source")
    filled = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = filled.mapInArrow(releasing(_count), "lang string, source string, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(W.partitionBy("lang", "term"))  # a row for each source
    kept = materialize(counted.withColumn("docs", in_lang).filter(F.col("docs") >= least_docs).select("lang", "term", "source", "n"), "kept-terms")
    in_order = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    schema = "chunk long, lang string, terms array<binary>, sources array<string>, source_no array<int>, id array<int>, n array<long>"
    chunks = materialize(in_order.mapInArrow(releasing(_chunks), schema), "chunks")

    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("count"))
    groups = filled.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").fillna(0, "count")
    listed = F.array_sort(F.collect_list(F.struct("source", "count")))
    langs = groups.groupBy("lang").agg(listed.alias("g"), F.sum("count").alias("lang_count"))
    n_terms = chunks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("n_terms"))
    langs = materialize(langs.join(n_terms, "lang", "left").select("lang", F.col("g.source").alias("all_sources"), F.col("g.count").alias("all_counts"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "lang_count"), "languages")

    # all chunks of a language meet its one row, so both are salted
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = chunks.withColumn("salt", F.pmod(F.hash("chunk"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    met = met.select("lang", "terms", "sources", "source_no", "id", "n", "all_sources", "all_counts", "n_terms", "lang_count")
    scored = materialize(met.mapInArrow(releasing(_score), "lang string, source string, part string, item binary, value long"), "differences")

    sums = scored.filter("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = langs.select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).filter("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = scored.filter("part = 'term'").withColumn("item", F.col("item").cast("string"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # sources, or leaders of chunks
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).filter(F.col("rank") <= most_terms))
