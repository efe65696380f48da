"""Each operator over its whole table, with production parameters, and the same in SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, divergence, exact_dedup, fingerprints, jaccard_join, quality, resampling, secrets, sharding, toxicity, url_filter
from .storage import is_trained_on, read_table

#: The vocabulary file of these queries; the operator takes any path.
TOKENIZER = os.environ.get("RANKLOOM_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
N_SHARDS = 8


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _judged(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", (~is_trained_on(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _judged(toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, read_table(spark, sf_dir, "labels"))))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _judged(quality.score_quality(docs, quality.learn_quality(docs, read_table(spark, sf_dir, "labels"))))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(secrets.spans_text(F.col("spans"), base_only=True), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, secrets.spans_text(F.col("spans")).alias("spans"), "n_entropy")


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    read = chat_format.read_back(chat_format.format_chats(chat_format.turn_events(rows.unionByName(probe))))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.bounded_load_shards(read_table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with the number of the document that they show, which their path names, and the labelled outcomes of these numbers."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    keyed = pages.select("page_id", "url", F.when(number != "", number.cast("long")).alias("key"))
    return keyed, labels.select(F.col("doc_id").alias("key"), (1 - F.col("quality")).alias("bad"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, outcomes = page_outcomes(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return url_filter.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.audit_edits(read_table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_leaks": benchmark_leaks,
    "op2_toxic_documents": toxic_documents,
    "op3_ngram_jaccard": ngram_jaccard,
    "op4_quality_scores": quality_scores,
    "op5_secret_spans": secret_spans,
    "op6_chat_texts": chat_texts,
    "op7_shards": shards,
    "op8_bpe_round_trip": bpe_round_trip,
    "op9_url_verdicts": url_verdicts,
    "op10_exact_copies": exact_copies,
    "op11_importance_resample": importance_resample,
    "op12_multiset_fingerprints": multiset_fingerprints,
    "op13_source_divergence": source_divergence,
}

_SHINGLES = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
"""

_STRENGTH = """CASE WHEN n > 0 THEN least(greatest(CASE WHEN (q - 2 * m * bad + m * m * n) / n - m * (1 - m) * c / n > 1e-9
  THEN m * (1 - m) / ((q - 2 * m * bad + m * m * n) / n - m * (1 - m) * c / n) - 1 ELSE 1000 END, 2), 1000) ELSE 1000 END"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": "WITH RECURSIVE "
    + _SHINGLES
    + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "op6_chat_texts": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, regexp_replace(text, '(\\|<</SYS>>|\[/INST\]|\[/ROLE\]|<<SYS>>|\[INST\]|\[ROLE\]|\[TEXT\]|</s>|<s>)', '\\\1', 'g') AS escaped FROM turns),
sized AS (SELECT *, length(escaped) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS chars FROM shown)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op9_url_verdicts": r"""
WITH named AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    try_cast(nullif(regexp_extract(coalesce(url, ''), '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1), '') AS BIGINT) AS key FROM pages),
worst AS (SELECT doc_id AS key, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
known AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM named LEFT JOIN worst USING (key) GROUP BY 1),
bare AS (SELECT *, regexp_replace(host, ':[0-9]*\z', '') AS b FROM known),
hosts AS (SELECT host, n, bad,
  regexp_extract(b, '(?:^|\.)((?:blogspot\.com|github\.io|gitlab\.io|herokuapp\.com|netlify\.app|pages\.dev|web\.app|wordpress\.com|(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}|[^.]*))\z', 1) AS suffix,
  regexp_extract(b, '(?:^|\.)((?:[^.]+\.)?(?:blogspot\.com|github\.io|gitlab\.io|herokuapp\.com|netlify\.app|pages\.dev|web\.app|wordpress\.com|(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}|[^.]*))\z', 1) AS domain FROM bare),
domains AS (SELECT domain, suffix, CAST(sum(n) AS DOUBLE) AS n, sum(bad) AS bad, coalesce(sum(bad * bad / n) FILTER (WHERE n > 0), 0) AS q, count(*) FILTER (WHERE n > 0) AS c FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, coalesce(sum(bad * bad / n) FILTER (WHERE n > 0), 0) AS q, count(*) FILTER (WHERE n > 0) AS c FROM domains GROUP BY 1),
t0 AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad, coalesce(sum(bad * bad / n) FILTER (WHERE n > 0), 0) AS q, count(*) FILTER (WHERE n > 0) AS c FROM suffixes),
t1 AS (SELECT *, (bad + 0.2::DOUBLE) / (n + 2.0::DOUBLE) AS m FROM t0),
t AS (SELECT m, STRENGTH AS k FROM t1),
s1 AS (SELECT suffix, n, bad, q, c, (bad + t.k * t.m) / (n + t.k) AS m FROM suffixes, t),
s AS (SELECT suffix, m, STRENGTH AS k FROM s1),
d1 AS (SELECT domain, n, bad, q, c, (bad + s.k * s.m) / (n + s.k) AS m FROM domains JOIN s USING (suffix)),
d AS (SELECT domain, m, STRENGTH AS k FROM d1),
h AS (SELECT host, (bad + d.k * d.m) / (n + d.k) AS rate, n + d.k AS weight FROM hosts JOIN d USING (domain)),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN rate - 1.0 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN h USING (host)
""".replace("STRENGTH", _STRENGTH),
    "op10_exact_copies": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op11_importance_resample": r"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT doc_id, text, TRUE AS ours FROM documents UNION ALL SELECT item_id, text, FALSE FROM benchmark),
words AS (SELECT row_number() OVER () AS r, doc_id, ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
places AS (SELECT r, ours, w, unnest(range(1, len(w) + 1)) AS i FROM words),
features AS (SELECT r, ours, unnest([w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS f FROM places),
counted AS (SELECT r, ours, f, count(*) AS n FROM features WHERE f IS NOT NULL GROUP BY ALL),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)),
summed AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i:
    (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS bucket FROM hexed, step),
bucketed AS (SELECT r, ours, bucket, n FROM counted JOIN summed USING (f)),
buckets AS (SELECT unnest(range(10000)) AS bucket),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT ours), 0)::DOUBLE AS t FROM bucketed),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE NOT ours), 0)::DOUBLE + 1) * (any_value(totals.s) + 10000) / ((coalesce(sum(n) FILTER (WHERE ours), 0)::DOUBLE + 1) * (any_value(totals.t) + 10000))))::BIGINT AS gain
  FROM buckets LEFT JOIN bucketed USING (bucket), totals GROUP BY bucket),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gains USING (bucket) WHERE ours GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE ours),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
""",
    "op13_source_divergence": r"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT r, lang, source, unnest(w) AS term FROM texts),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM each GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
groups AS (SELECT DISTINCT lang, source FROM texts),
sizes AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shared AS (SELECT c.lang, source, term, c.n, 1 + 1000000000::HUGEINT * (c.n + 2) // (sum(c.n) OVER (PARTITION BY c.lang, source)::HUGEINT + 2 * v) AS p,
  1 + 1000000000::HUGEINT * (lang_n + 2) // (s.n + 2 * v) AS q FROM cells c JOIN sizes s USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shared WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
