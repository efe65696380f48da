"""Joins of URLs and hosts with tables of rules, of any length: by the longest prefix, by the domains above a host.

A value is turned into the few keys under which a rule for it could stand, and these are joined by equality; no value meets all rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORIGIN, _SCHEME, _HOST = r"^([a-z][a-z0-9+.-]*://[^/?#]*)", r"^([a-z][a-z0-9+.-]*://)", r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def longest_prefix(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule: of the rules (rule) that a URL (url) starts with, the longest. URLs without one have no row; repeated rows count once.

    A rule holds for URLs of its own origin, or of its scheme if it names no host. Only the lengths that the rules of an origin have are
    looked up, so a URL gives as many keys as there are lengths, however many rules they share.
    """
    named = rules.select("rule", F.regexp_extract("rule", _ORIGIN, 1).alias("origin")).filter("origin <> ''").distinct()
    lengths = named.groupBy("origin").agg(F.collect_set(F.length("rule")).alias("lengths"))  # lengths are bounded by those of URLs
    at = urls.select("url").filter("url IS NOT NULL").distinct()
    at = at.select("url", F.explode(F.array_distinct(F.array(F.regexp_extract("url", _ORIGIN, 1), F.regexp_extract("url", _SCHEME, 1)))).alias("origin"))
    keys = at.join(lengths, "origin").select("url", F.explode(F.filter("lengths", lambda n: n <= F.length("url"))).alias("n"))
    met = keys.select("url", F.substring(F.col("url"), F.lit(1), F.col("n")).alias("rule")).distinct().join(named.select("rule"), "rule")
    return met.groupBy("url").agg(F.max_by("rule", F.length("rule")).alias("rule"))


def domains_above(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and all columns of the rules (domain, ...) whose domain is the host or stands above it; one row for each."""
    labels = F.split("host", r"\.")
    size = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, i, size), "."))
    # www.example.com: itself, example.com, com
    keys = hosts.select("host").filter("host <> ''").distinct().select("host", F.explode(suffixes).alias("domain"))
    return keys.join(rules, "domain")


def most_specific_property(urls: DataFrame, properties: DataFrame) -> DataFrame:
    """url, property for every distinct URL: the longest URL prefix among the properties (property), else the longest domain
    (`sc-domain:example.com`) that holds its host, else null. Texts of the same length can't both be prefixes of a URL."""
    domain = F.col("property").startswith("sc-domain:")
    prefixes = longest_prefix(urls, properties.filter(~domain).select(F.col("property").alias("rule")))
    every = urls.select("url").filter("url IS NOT NULL").distinct()
    hosted = every.withColumn("host", F.lower(F.regexp_extract("url", _HOST, 1)))
    named = properties.filter(domain).select(F.lower(F.substring("property", 11, 1 << 20)).alias("domain"), "property")
    above = domains_above(hosted, named).groupBy("host").agg(F.min_by("property", F.struct(-F.length("domain"), F.col("property"))).alias("of_domain"))
    t = hosted.join(prefixes, "url", "left").join(above, "host", "left")
    return t.select("url", F.coalesce("rule", "of_domain").alias("property"))
