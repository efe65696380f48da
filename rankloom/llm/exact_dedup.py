"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where its own characters say so, each distinct chunk is compared in full once, and documents are then
compared by their ordered lists of chunk identifiers, so long texts don't travel to their copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .storage import MOST_SENT_IDS, materialize, sent_if_few

WHITESPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends at the first boundary after so many UTF-8 bytes, or at LONGEST bytes.
SHORTEST, LONGEST = 512, 4096


def _boundary_class(multiplier: int) -> str:
    """A character whose last byte is among a quarter of them, dealt by a multiplicative hash. A whole alphabet may share the bytes before."""
    return r"(?:[\xc0-\xdf]|[\xe0-\xef][\x80-\xbf]|[\xf0-\xf7][\x80-\xbf]{2})?[" + "".join(f"\\x{b:02x}" for b in range(0xC0) if (b * multiplier) % 251 % 4 == 0) + "]"


#: Three neighbouring characters decide a boundary, one place in 64 or so, in every alphabet.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST - 12}}}?{_boundary_class(97)}{_boundary_class(59)}{_boundary_class(151)}|.{{1,{LONGEST}}}"


def normalise(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def chunks_of(text: Column) -> Column:
    """The chunks of the text's UTF-8 bytes, each byte shown as the character of its number: boundaries depend on content in all alphabets."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def _colliding(chunks: DataFrame) -> DataFrame | None:
    """(chunk_hash, chunk) of every hash that stands for more than one chunk text, None if there is no such hash.

    Equal chunks are combined before the shuffle, so every chunk text moves once for each task that has it.
    """
    distinct = chunks.groupBy("chunk_hash", "chunk").agg(F.lit(1).alias("one"))
    shared = materialize(distinct.groupBy("chunk_hash").agg(F.count("*").alias("n_texts")).filter("n_texts > 1"), "shared-hashes")
    return None if shared.isEmpty() else distinct.join(shared, "chunk_hash", "left_semi").select("chunk_hash", "chunk")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id (smallest id among equal texts), group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after each run of ASCII white space became one space. Null and empty texts are equal to each
    other. Repeated rows count in group_size, and all rows with the kept id are kept. Null ids are never preferred: keep_id is null
    only if the whole group has none, and then its rows are kept. An empty table gives no rows; other columns are ignored.
    chunk_hash names a chunk before it is verified; hashes shared by different chunk texts are told apart by a variant number.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm")).withColumn("chunks", chunks_of(F.col("norm")))
    collisions = _colliding(base.select(F.explode("chunks").alias("chunk")).withColumn("chunk_hash", chunk_hash(F.col("chunk"))))
    digest = F.sha2(F.col("norm"), 256).alias("text_sha256")
    recipe = F.transform("chunks", lambda c: chunk_hash(c))
    rows = base.select("doc_id", digest, recipe.alias("recipe"))
    if collisions is not None:
        rows = _with_variants(base, rows, collisions, chunk_hash)
    rows = materialize(rows, "recipes")
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # written first, so that the join has a shuffle of its own on either side, whose large partitions Spark can split
    groups = materialize(groups.filter("group_size > 1"), "groups")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


def _with_variants(base: DataFrame, rows: DataFrame, collisions: DataFrame, chunk_hash) -> DataFrame:
    """Recipes of (hash, variant): chunks that share a hash get numbers in the order of their texts."""
    variants = collisions.withColumn("variant", F.row_number().over(W.partitionBy("chunk_hash").orderBy("chunk")))
    parts = base.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).distinct()
    ids = parts.withColumn("chunk_hash", chunk_hash(F.col("chunk"))).join(variants, ["chunk_hash", "chunk"], "left")
    part = F.struct("pos", "chunk_hash", F.coalesce("variant", F.lit(0)).alias("variant"))
    recipes = ids.groupBy("text_sha256").agg(F.array_sort(F.collect_set(part)).alias("recipe"))
    empty = F.array().cast(T.ArrayType(recipes.schema["recipe"].dataType.elementType))
    return rows.drop("recipe").join(recipes, "text_sha256", "left").withColumn("recipe", F.coalesce("recipe", empty))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier id already has. Rows that repeat an id are judged by their own text."""
    # digests as bytes; the rows are written first, so that documents needn't be shuffled to lose them
    dropped = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped_id"), F.unhex("text_sha256").alias("_dropped_text")).distinct()
    dropped = sent_if_few(materialize(dropped, "copies"), MOST_SENT_IDS)
    same = docs["doc_id"].eqNullSafe(F.col("_dropped_id")) & (F.unhex(F.sha2(normalise(docs["text"]), 256)) == F.col("_dropped_text"))
    return docs.join(dropped, same, "left_anti")
