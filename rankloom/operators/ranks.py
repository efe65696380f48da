"""Places and running sums in a total order, however few groups there are: no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written


def running(rows: DataFrame, by: list[str], order: list[Column], place: str | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with their place, from 1, in the order of their group, and sums of columns up to and with them.

    Spark cuts the whole order into ranges; rows are counted and added up within each range, and the ranges before add their totals.
    order has to be total within a group; nulls add nothing. A sum is null as long as all values so far are.
    """
    sums = sums or {}
    named = rows.withColumns({f"_v_{name}": value for name, value in sums.items()})
    cut = written(named.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*by, "_range").agg(F.count("*").alias("_size"), *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    before = W.partitionBy(*by, F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), *[F.sum(f"_t_{name}").over(before).alias(f"_b_{name}") for name in sums])
    here = W.partitionBy(*by, "_range").orderBy(*order)
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({"_place": F.row_number().over(here)} | {f"_s_{name}": F.sum(f"_v_{name}").over(so_far) for name in sums})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]  # null keys are a group of their own
    offsets = offsets.withColumnsRenamed({c: f"_of_{c}" for c in by} | {"_range": "_at"})
    joined = local.join(offsets, [*same, F.col("_range") == F.col("_at")])
    out = {place: F.col("_place") + F.col("_before")} if place else {}
    for name in sums:
        out[name] = F.coalesce(F.col(f"_b_{name}") + F.col(f"_s_{name}"), F.col(f"_b_{name}"), F.col(f"_s_{name}"))
    return joined.withColumns(out).select(*rows.columns, *out)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1, in the order of their group."""
    return running(rows, by, order, place=name)


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their group up to and with them."""
    return running(rows, by, order, sums={name: value})
