"""Candidates of patterns by their numbers: combinations of value lists of any size, without holding or crossing the lists.

A set of candidates is a range of numbers. Each number is decoded to places in the set's value lists, by mixed radix for a matrix and by
the triangular root for pairs, and the places are joined with the numbered values. Ranges split evenly over tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .tables import written

#: Numbers that a task decodes.
PER_TASK = 200_000


@dataclass(frozen=True)
class PatternSet:
    """shape: `terms` (one list, `value`), `matrix` (the lists named by axes, the last one runs fastest) or `pairs` of one list, `value`.
    pairing of pairs: `all` (each two values once), `anchor` (one value with each other) or `explicit`."""

    id: str
    kind: str
    shape: str
    queries: tuple[str, ...]
    path: str | None = None
    policy: str = "evidence-led"
    axes: tuple[str, ...] = ("value",)
    pairing: str = "all"
    anchor: str | None = None
    variables: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        if self.shape not in ("terms", "matrix", "pairs") or self.pairing not in ("all", "anchor", "explicit"):
            raise ValueError(f"no such shape or pairing: {self.shape}, {self.pairing}")
        object.__setattr__(self, "variables", ("left", "right") if self.shape == "pairs" else self.axes)


def in_turns(totals: list[int], limit: int | None) -> list[int]:
    """How many each list gives when all give one by turns until there are `limit`."""
    if limit is None or sum(totals) <= limit:
        return totals
    low, high = 0, max(totals)
    while low < high:  # the most whole rounds
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(t, mid) for t in totals) <= limit else (low, mid - 1)
    given = [min(t, low) for t in totals]
    for i, t in enumerate(totals):
        if t > low and sum(given) < limit:
            given[i] += 1
    return given


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def digits(number: Column, sizes: list[int]) -> list[Column]:
    """The places of a combination in lists of these sizes; the last list runs fastest."""
    out, step = [], 1
    for size in reversed(sizes):
        out.append(F.pmod(_div(number, F.lit(step)), F.lit(size).cast("long")))
        step *= size
    return out[::-1]


def pair_of(number: Column, size: int) -> tuple[Column, Column]:
    """Places i < j of a pair among `size` values, in the order (0, 1), (0, 2), ... by the root of the triangle."""
    m, last = F.lit(2 * size - 1).cast("long"), F.lit(size * (size - 1) // 2 - 1).cast("long")
    before = lambda i: _div(i * (m - i), F.lit(2))  # noqa: E731  pairs whose first place is under i
    # from the end, where the root of a small number is sure; at the other end it may be off by one
    root = F.floor((F.sqrt(8.0 * (last - number).cast("double") + 1) - 1) / 2).cast("long")
    i = F.greatest(F.lit(0).cast("long"), F.lit(max(0, size - 2)).cast("long") - root)
    i = F.when(before(i) > number, i - 1).when(before(i + 1) <= number, i + 1).otherwise(i)
    return i, number - before(i) + i + 1


_NAME = re.compile(r"\{([a-z][a-z0-9-]{0,39})\}")


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced, unknown ones by nothing; runs of white space are one space, trimmed."""
    parts = _NAME.split(template)
    texts = [F.lit(p) if i % 2 == 0 else values.get(p, F.lit("")) for i, p in enumerate(parts)]
    return F.trim(F.regexp_replace(F.concat(*texts), r"\s+", " "))


def path_of(template: str, ids: dict[str, Column]) -> Column:
    bare = F.regexp_replace(F.regexp_replace(filled(template, ids), "/+", "/"), "/$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def rendered(numbers: DataFrame, s: PatternSet) -> DataFrame:
    """Candidates from rows with number and, for each variable, <variable>_id and <variable>_label."""
    names = sorted(s.variables)
    ids, labels = ({v: F.col(f"`{v}_{what}`") for v in names} for what in ("id", "label"))
    queries = F.array_sort(F.array_distinct(F.array(*[filled(q, labels) for q in s.queries]))) if s.queries else F.array().cast("array<string>")
    path = path_of(s.path, ids) if s.path else F.lit(None).cast("string")
    paths = F.array(path) if s.path else F.array().cast("array<string>")
    if s.kind == "comparison" and s.shape == "pairs" and s.path:
        paths = F.array_sort(F.array_distinct(F.array(path, path_of(s.path, ids | {"left": ids["right"], "right": ids["left"]}))))
    label = F.concat(F.lit(f"{s.id}:"), F.concat_ws(",", *[F.concat(F.lit(f"{v}="), ids[v]) for v in names]))
    return numbers.select(
        F.lit(s.id).alias("set_id"), label.alias("candidate"), "number", F.lit(s.kind).alias("kind"), F.lit(s.shape).alias("shape"), F.lit(s.policy).alias("policy"), path.alias("path"), paths.alias("inventory_paths"), queries.alias("queries")
    )


def generate(sets: list[PatternSet], values: DataFrame, pairs: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (set_id, candidate, number, kind, shape, policy, path, inventory_paths, queries) and one row for each set: set_id,
    planned, returned, omitted, planned_variants.

    values: set_id, axis, value_id, label; each id once in a list, lists are in the order of their ids. pairs: set_id, ord, left_id,
    right_id of explicit pairings; pairs of unknown ids are planned but not returned. With a limit the sets give candidates by turns.
    An empty list gives no candidates. Paths of comparisons also stand for the pair turned round.
    """
    spark = values.sparkSession
    numbered = ranked(values.select("set_id", "axis", "value_id", "label"), ["set_id", "axis"], [F.col("value_id")], "no")
    numbered = written(numbered.withColumn("no", F.col("no") - 1), "values")
    sizes = {(r.set_id, r.axis): r.n for r in numbered.groupBy("set_id", "axis").agg(F.count("*").alias("n")).collect()}  # a row for each list
    listed = lambda s, axis, as_: numbered.filter((F.col("set_id") == s.id) & (F.col("axis") == axis)).select(F.col("no").alias(f"{as_}_no"), F.col("value_id").alias(f"{as_}_id"), F.col("label").alias(f"{as_}_label"))

    known, planned, totals, anchors = {}, [], [], {}
    for s in sets:
        n = [sizes.get((s.id, a), 0) for a in s.axes]
        if s.shape != "pairs":
            planned.append(reduce(lambda a, b: a * b, n, 1))
            totals.append(planned[-1])
        elif s.pairing == "all":
            planned.append(n[0] * (n[0] - 1) // 2)
            totals.append(planned[-1])
        elif s.pairing == "anchor":
            planned.append(max(0, n[0] - 1))
            anchors[s.id] = numbered.filter((F.col("set_id") == s.id) & (F.col("axis") == "value") & (F.col("value_id") == s.anchor)).first()
            totals.append(planned[-1] if anchors[s.id] else 0)
        else:
            mine = pairs.filter(F.col("set_id") == s.id)
            planned.append(mine.count())
            found = mine.join(listed(s, "value", "left"), "left_id").join(listed(s, "value", "right"), "right_id").drop("left_no", "right_no")
            known[s.id] = written(ranked(found, ["set_id"], [F.col("ord"), F.col("left_id"), F.col("right_id")], "number").withColumn("number", F.col("number") - 1), "pairs")
            totals.append(known[s.id].count())
    returned = in_turns(totals, limit)

    def candidates(s: PatternSet, n: int) -> DataFrame:
        number = F.col("number")
        if s.id in known:
            return rendered(known[s.id].filter(number < n), s)
        rows = spark.range(0, n, 1, max(1, -(-n // PER_TASK))).withColumnRenamed("id", "number")
        if s.shape != "pairs":
            places = dict(zip(s.axes, digits(number, [max(1, sizes.get((s.id, a), 0)) for a in s.axes]), strict=True))
            axis_of = {a: a for a in s.axes}
        elif s.pairing == "all":
            places, axis_of = dict(zip(("left", "right"), pair_of(number, sizes.get((s.id, "value"), 0)), strict=True)), dict.fromkeys(("left", "right"), "value")
        else:
            at = anchors[s.id]["no"] if anchors[s.id] else 0
            places, axis_of = {"left": F.lit(at).cast("long"), "right": F.when(number < at, number).otherwise(number + 1)}, dict.fromkeys(("left", "right"), "value")
        rows = rows.select("number", *[c.alias(f"{v}_no") for v, c in places.items()])
        for v in places:
            rows = rows.join(listed(s, axis_of[v], v), f"{v}_no")
        return rendered(rows, s)

    summary = [(s.id, p, r, max(0, p - r), p * len(s.queries)) for s, p, r in zip(sets, planned, returned, strict=True)]
    return (
        reduce(DataFrame.unionByName, [candidates(s, n) for s, n in zip(sets, returned, strict=True)]),
        spark.createDataFrame(summary, "set_id string, planned long, returned long, omitted long, planned_variants long"),
    )


def reviewed(candidates: DataFrame, rows: DataFrame, urls: DataFrame, key) -> DataFrame:
    """Candidates beside the queries (query, page, clicks, impressions, position), and the URLs (url) that there are.

    key: the form in which queries are compared. A candidate that comes twice, from a list of pairs, is one. For each candidate: n_matched of its queries, clicks, impressions, position and n_pages of
    these, n_urls at its paths, and the review: `possible-overlap`, `existing-topic`, `strategic-gap`, `search-evidenced-gap`,
    `research-only` or `inventory-unknown`.
    """
    candidates = written(candidates.dropDuplicates(["set_id", "candidate"]), "candidates")
    path = lambda url: F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", "")  # noqa: E731  "" for the root
    keyed = rows.select(key(F.col("query")).alias("key"), "page", "clicks", "impressions", (F.col("position") * F.col("impressions")).alias("weighted"))
    asked = candidates.select("candidate", F.explode("queries").alias("query")).select("candidate", key(F.col("query")).alias("key"), "query")
    # queries that come down to the same text match the same rows each
    asked = asked.groupBy("candidate", "key").agg(F.count("*").alias("n_variants"))
    pages = written(keyed.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key", "page").agg(*[F.sum(c).alias(c) for c in ("clicks", "impressions", "weighted")]), "asked-pages")
    sums = pages.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("clicks", "impressions", "weighted")])
    matched = asked.join(sums, "key").groupBy("candidate").agg(F.sum("n_variants").alias("n_matched"), *[F.sum(F.col("n_variants") * F.col(c)).alias(c) for c in ("clicks", "impressions", "weighted")])
    seen = asked.join(pages.select("key", "page"), "key").select("candidate", "page").distinct()
    n_pages = seen.groupBy("candidate").agg(F.count("*").alias("n_pages"))
    mine = candidates.select("candidate", F.explode("inventory_paths").alias("p")).select("candidate", F.regexp_replace("p", "/+$", "").alias("path")).distinct()
    at = mine.join(urls.select("url", path(F.col("url")).alias("path")).distinct(), "path")
    n_urls = at.groupBy("candidate").agg(F.count("*").alias("n_urls"))
    own = seen.withColumn("path", path(F.col("page"))).join(at.select("candidate", "path").distinct(), ["candidate", "path"]).select("candidate", F.lit(True).alias("on_own")).distinct()
    t = candidates.join(matched, "candidate", "left").join(n_pages, "candidate", "left").join(n_urls, "candidate", "left").join(own, "candidate", "left").fillna(0, ["n_matched", "clicks", "impressions", "weighted", "n_pages", "n_urls"])
    kept, existing = F.col("n_matched") > 0, F.col("n_urls") == 1
    review = (
        F.when((F.col("n_urls") > 1) | existing & kept & F.col("on_own").isNull(), "possible-overlap").when(existing, "existing-topic").when(F.col("path").isNull(), "inventory-unknown")
        .when(F.col("policy") == "complete-set", "strategic-gap").when(kept, "search-evidenced-gap").otherwise("research-only")
    )
    position = F.when(F.col("impressions") > 0, F.col("weighted") / F.col("impressions")).otherwise(0.0)
    return t.select("set_id", "candidate", "path", F.size("queries").alias("n_queries"), "n_matched", "clicks", "impressions", position.alias("position"), "n_pages", "n_urls", review.alias("review"))
