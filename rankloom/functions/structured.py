"""Structured data of pages: JSON-LD items, their types, and what a rich result would still need. JSON functions of the JVM only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
#: Properties that a rich result of a type needs; of alternatives separated by a bar, one.
REQUIRED = {
    "BreadcrumbList": ["itemListElement"], "Event": ["name", "startDate", "location"], "FAQPage": ["mainEntity"], "JobPosting": ["title", "description", "datePosted", "hiringOrganization", "jobLocation"], "LocalBusiness": ["name", "address"],
    "Product": ["name", "offers|review|aggregateRating"], "Recipe": ["name", "image"], "Review": ["author", "itemReviewed", "reviewRating"], "SoftwareApplication": ["name", "offers", "aggregateRating|review"], "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
}
_ITEMS = "array<map<string,string>>"


def blocks(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1)), lambda b: F.trim(b))


def is_json(block: Column) -> Column:
    return F.try_parse_json(block).isNotNull()


def items_of(block: Column) -> Column:
    """The items of a block, a single one, a list or a graph, as maps whose nested values stay JSON; none for broken blocks."""
    graph = F.get_json_object(block, "$['@graph']")
    whole = F.when(graph.isNotNull(), graph).when(block.startswith("["), block).otherwise(F.concat(F.lit("["), block, F.lit("]")))
    return F.coalesce(F.when(is_json(block), F.from_json(whole, _ITEMS)), F.array().cast(_ITEMS))


def types_of(item: Column) -> Column:
    """The types of an item, one or a list, without the vocabulary before them."""
    named = item["@type"]
    several = F.coalesce(F.when(named.startswith("["), F.from_json(named, "array<string>")), F.array(named))
    return F.filter(F.transform(several, lambda t: F.regexp_replace(t, "^.*[/#]", "")), lambda t: t.isNotNull())


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """keep, item, type: a row for each type of each item of the pages' html."""
    each = pages.select(*keep, F.explode(F.flatten(F.transform(blocks(F.col("html")), items_of))).alias("item"))
    return each.select(*keep, "item", F.explode(types_of(F.col("item"))).alias("type"))


def missing_properties(item: Column, kind: Column) -> Column:
    """The required properties that an item of a known type lacks, in order; null for other types."""
    has = lambda name: F.coalesce(item[name].isNotNull() & ~item[name].isin("", "[]", "{}", "null"), F.lit(False))
    lacks = lambda names: F.when(~reduce(lambda a, b: a | b, [has(n) for n in names.split("|")]), F.lit(names))
    return reduce(lambda rest, kv: F.when(kind == kv[0], F.array_compact(F.array(*[lacks(n) for n in kv[1]]))).otherwise(rest), REQUIRED.items(), F.lit(None).cast("array<string>"))
