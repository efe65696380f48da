"""Joins of intervals that overlap, by bins of time, and totals over those that do, without their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins that an interval covers at its own level at most; bins of the next level are so many times as wide.
SPAN = 32
#: Levels are enough for any two dates.
LEVELS = 6
#: Levels of halves that hold any two days, numbers of 32 bits and some more.
HALVES = 34


def _binned(rows: DataFrame, start: str, end: str, prefix: str) -> DataFrame:
    """Rows with a copy for each bin that they cover, at the finest level where these are few, and at all levels above."""
    first, last = F.unix_date(start), F.unix_date(end)
    width = [SPAN**level for level in range(LEVELS)]
    at = lambda day, level: F.floor(day / width[level]).cast("long")
    own = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        own = F.when(at(last, level) - at(first, level) < SPAN, level).otherwise(own)

    def bins(level: int) -> Column:
        return F.transform(F.sequence(at(first, level), at(last, level)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"), at(first, level).alias(f"{prefix}_first")))

    none = F.slice(bins(LEVELS - 1), 1, 0)
    some = F.flatten(F.array(*[F.when(F.col(f"{prefix}_own") <= v, bins(v)).otherwise(none) for v in range(LEVELS)]))
    return rows.filter((F.col(start) <= F.col(end))).withColumn(f"{prefix}_own", own).withColumn("_at", F.explode(some)).select("*", "_at.*").drop("_at")


def overlapping(left: DataFrame, right: DataFrame, now: Column, padding: int = 0) -> DataFrame:
    """Pairs of left (start, end, ...) and right (begin, until, ...) whose days meet, the right side widened by padding days at both ends.

    An interval holds both its ends, an open one (end or until null) lasts until `now`; one without a start, or that ends before it
    starts, meets nothing. Columns of the two sides have to differ. Intervals are dealt to bins of days, long ones to wider bins, and
    meet by equality in the first bin that both cover, at the wider of their levels; so a pair comes out once.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    a = _binned(left.withColumn("_l_start", F.col("start")).withColumn("_l_end", F.coalesce("end", now)), "_l_start", "_l_end", "_l")
    b = _binned(right.withColumn("_r_start", F.date_sub("begin", padding)).withColumn("_r_end", F.date_add(F.coalesce("until", now), padding)), "_r_start", "_r_end", "_r")
    pairs = a.join(b, ["level", "bin"])
    once = (F.col("level") == F.greatest("_l_own", "_r_own")) & (F.col("bin") == F.greatest("_l_first", "_r_first"))
    meet = (F.col("_l_start") <= F.col("_r_end")) & (F.col("_r_start") <= F.col("_l_end"))
    return pairs.filter(once & meet).select(*left.columns, *right.columns)


def _blocks(rows: DataFrame, first: str, last: str) -> DataFrame:
    """rows with level and bin of the few blocks, 2^level days wide and as wide as fit, that make up the days from first to last."""
    own = rows.filter(F.col(first) <= F.col(last)).withColumn("level", F.explode(F.expr(f"sequence(0, least({HALVES - 1}, 1 + CAST(log2({last} - {first} + 1) AS INT)))")))
    # blocks inside are those from _lo to before _hi, wider ones from _lo2 to before _hi2
    own = own.withColumn("_lo", F.expr(f"shiftright({first} + shiftleft(1L, level) - 1, level)")).withColumn("_hi", F.expr(f"shiftright({last} + 1L, level)"))
    own = own.filter("_lo < _hi").withColumn("_lo2", F.expr("shiftright(_lo + 1, 1)")).withColumn("_hi2", F.expr("shiftright(_hi, 1)"))
    alone = lambda b: f"shiftright({b}, 1) < _lo2 OR shiftright({b}, 1) >= _hi2"
    # those in no wider block inside are at most the first and the last one
    ends = F.expr(f"array_compact(array(CASE WHEN {alone('_lo')} THEN _lo END, CASE WHEN _hi - 1 > _lo AND ({alone('(_hi - 1)')}) THEN _hi - 1 END))")
    return own.withColumn("bin", F.explode(ends)).drop("_lo", "_hi", "_lo2", "_hi2")


def _above(rows: DataFrame, day: str) -> DataFrame:
    """rows with level and bin of the blocks that hold a day."""
    return rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(HALVES - 1)))).withColumn("bin", F.expr(f"shiftright(CAST({day} AS BIGINT), level)"))


def meeting_totals(left: DataFrame, right: DataFrame, now: Column, padding: int = 0, sums: tuple[str, ...] = (), least: tuple[str, ...] = ()) -> DataFrame:
    """The rows of left (start, end, ...), with the sums and the least values of columns of the rows of right (begin, until, ...) that
    `overlapping` would pair each with. Without any, sums are 0 and least values null.

    No pairs are made. What meets a window begins in it, or has begun before and lasts on its first day. Totals of the first kind stand
    at the blocks of days in which rows begin, and a window adds those of the blocks that it is made of. Totals of the second stand at
    the blocks that the days after a row's first one are made of, and a window adds those of the blocks that hold its first day. A row
    counts in one block that a window looks up, and rows of the same days count as one, so all tables are bounded by the days there are.
    """
    totals = lambda: [*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least]]
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    of = right.select(F.unix_date(F.date_sub("begin", padding)).alias("_first"), F.unix_date(F.date_add(F.coalesce("until", now), padding)).alias("_last"), *sums, *least)
    of = of.filter("_first <= _last").groupBy("_first", "_last").agg(*totals())
    key = ("kind", "level", "bin")
    begun = _above(of.groupBy("_first").agg(*totals()).withColumn("kind", F.lit("begins")), "_first").select(*key, *sums, *least)
    lasting = _blocks(of.withColumns({"kind": F.lit("lasts"), "_first": F.col("_first") + 1}), "_first", "_last").select(*key, *sums, *least)
    blocks = begun.union(lasting).groupBy(*key).agg(*totals())
    at = left.withColumn("_start", F.unix_date("start")).withColumn("_end", F.unix_date(F.coalesce("end", now)))
    windows = at.select("_start", "_end").filter("_start <= _end").distinct()
    looked = _blocks(windows.withColumn("kind", F.lit("begins")), "_start", "_end").unionByName(_above(windows.withColumn("kind", F.lit("lasts")), "_start"))
    met = looked.join(blocks, [*key]).groupBy("_start", "_end").agg(*totals())
    return at.join(met, ["_start", "_end"], "left").select(*left.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], *least)
