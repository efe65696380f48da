"""The first few rows or values of each group, however large it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from .ranks import ranked
from .tables import written

#: Parts that a group's rows are dealt to before the first of all parts are compared.
PARTS = 64


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group in an order that is total within it, with their place as name. Null keys are groups too."""
    kept = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys]), F.lit(PARTS)))
    for by in ([*keys, "_part"], keys):
        kept = kept.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return kept.drop("_part")


def with_first(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """groups with the k least distinct values of each, in order, as the array name; null values don't count."""
    named = rows.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(f"{c}_of") for c in keys], F.col(value).alias("value")).distinct()
    of = [f"{c}_of" for c in keys]
    first = first_rows(named, of, [F.col("value")], k, "n").groupBy(*of).agg(F.array_sort(F.collect_list("value")).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in keys]
    joined = groups.join(first, same, "left").drop(*of)
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def stratified(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each group in the columns pick, from 1, and kind: its first row, its last, the one in the middle, then the others from
    the first on. order has to be total within a group; no group has to fit one task."""
    placed = ranked(rows, by, order, "_n")
    last = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.max("_n").alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    n, end = F.col("_n"), F.col("_last")
    middle = F.floor((end - 1) / 2) + 1
    kind = F.when(n == 1, "best").when(n == end, "worst").when(n == middle, "median").otherwise("fill")
    # of those that fill up, no more than k are ever taken
    kept = placed.join(last, same, "left").withColumn("kind", kind).filter((F.col("kind") != "fill") | (n <= k + 1))
    turn = F.when(F.col("kind") == "best", 0).when(F.col("kind") == "worst", 1).when(F.col("kind") == "median", 2).otherwise(2 + n)
    picked = kept.withColumn("pick", F.row_number().over(W.partitionBy(*by).orderBy(turn))).filter(F.col("pick") <= k)
    return picked.select(*rows.columns, "kind", "pick")


def fair_sample(links: DataFrame, limit: int) -> DataFrame:
    """pick, url: up to limit urls of links (source, url), source by source in turn: each gives the first of its urls that isn't taken yet.

    Sources and urls are in the order of their FNV-1a hashes, then of their texts. At most limit urls of a source can be taken before one
    is new, so no more of each are looked at; sources without a new one are left out before a turn, and the turn ends with the sample.
    """
    spark = links.sparkSession
    named = links.filter("source IS NOT NULL AND url IS NOT NULL").distinct().withColumn("url_hash", fnv1a(F.col("url")))
    first = first_rows(named, ["source"], [F.col("url_hash"), F.col("url")], limit + 1, "n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"])
    sources = written(first.groupBy("source").agg(listed.alias("urls")).withColumn("source_hash", fnv1a(F.col("source"))), "sources")
    taken: dict[str, None] = {}
    while len(taken) < limit:
        known = F.array(*[F.lit(u) for u in taken]).cast("array<string>")
        before = len(taken)
        for row in sources.filter(F.size(F.array_except("urls", known)) > 0).orderBy("source_hash", "source").select("urls").toLocalIterator():
            new = next((u for u in row["urls"] if u not in taken), None)
            if new is not None:
                taken[new] = None
            if len(taken) == limit:
                break
        if len(taken) == before:
            break
    return spark.createDataFrame([(i + 1, u) for i, u in enumerate(taken)], "pick int, url string")
