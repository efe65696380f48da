"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted for each host, registered domain and suffix. A beta-binomial prior shrinks every level towards the
one above it, by a strength that the spread between its members gives, and a host is blocked where the lower bound of its bad rate is
over the limit. Fixed rules go before the learned verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A host is blocked if its bad rate is over MOST_BAD with the certainty of Z standard deviations.
MOST_BAD, Z = 0.2, 1.0
#: The strength of a prior, in pages, is kept between these.
WEAKEST, STRONGEST = 2.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty where there is no :// or the url is null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no :// or the url is null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Names that form a suffix with a two-letter country code, and suffixes below which anybody can register.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org"]
OPEN_SUFFIXES = ["blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "web.app", "wordpress.com"]
#: The one rule for both levels: the leftmost place from which a suffix reaches the end of the host.
SUFFIX = "(?:" + "|".join([*(x.replace(".", r"\.") for x in OPEN_SUFFIXES), "(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}", "[^.]*"]) + ")"
PORT = r":[0-9]*\z"


def suffix_of(host: Column) -> Column:
    """co.uk, github.io, org: what is not registered by itself. Ports don't count."""
    return F.regexp_extract(F.regexp_replace(host, PORT, ""), rf"(?:^|\.)({SUFFIX})\z", 1)


def domain_of(host: Column) -> Column:
    """The suffix with one label more, if the host has one."""
    return F.regexp_extract(F.regexp_replace(host, PORT, ""), rf"(?:^|\.)((?:[^.]+\.)?{SUFFIX})\z", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule holds for its host and all hosts below."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _totals() -> list[Column]:
    """What a level keeps of its members: pages with an outcome, bad ones, the sum of bad * bad / n, and how many members have outcomes."""
    seen = F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))
    return [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.coalesce(F.sum(seen), F.lit(0.0)).alias("squares"), F.count_if(F.col("n") > 0).alias("members")]


def _strength(mean: Column) -> Column:
    """Strength of a beta prior with the given mean for the members of a level, by the method of moments over their rates."""
    n = F.col("n")
    spread = (F.col("squares") - 2 * mean * F.col("bad") + mean * mean * n) / n
    between = spread - mean * (1 - mean) * F.col("members") / n
    fitted = F.when(between > 1e-9, mean * (1 - mean) / between - 1).otherwise(F.lit(STRONGEST))
    return F.when(n > 0, F.least(F.greatest(fitted, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, domain, suffix, n, bad, rate and low (the posterior mean and its lower bound) for every host of outcomes (host, bad).

    Rows with a null outcome count as pages without one. Where nothing is known at all, a tenth is taken for bad. The rate of a level is
    (bad + strength * rate above) / (n + strength). Levels are added up from the hosts, which are written once; no level is read twice.
    """
    known = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = materialize(known.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*_totals())
    suffixes = materialize(domains.groupBy("suffix").agg(*_totals()), "suffixes")
    top = suffixes.agg(*_totals()).select(((F.coalesce("bad", F.lit(0.0)) + 0.2) / (F.coalesce("n", F.lit(0)) + 2.0)).alias("rate"), "n", "bad", "squares", "members")
    top = top.select("rate", F.coalesce(_strength(F.col("rate")), F.lit(STRONGEST)).alias("k")).first()  # one row

    share = lambda rate, k: (F.col("bad") + k * rate) / (F.col("n") + k)
    s = suffixes.withColumn("rate", share(F.lit(top["rate"]), F.lit(top["k"]))).select("suffix", F.col("rate").alias("suffix_rate"), _strength(F.col("rate")).alias("suffix_k"))
    d = domains.join(s, "suffix").withColumn("rate", share(F.col("suffix_rate"), F.col("suffix_k"))).select("domain", F.col("rate").alias("domain_rate"), _strength(F.col("rate")).alias("k"))
    h = hosts.join(d, "domain")
    h = h.select("host", "domain", "suffix", "n", "bad", share(F.col("domain_rate"), F.col("k")).alias("rate"), (F.col("n") + F.col("k")).alias("weight"))
    return h.withColumn("low", F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))).drop("weight")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, rate, low.

    outcomes has (key, bad): bad is 1 for a page found bad, 0 for a good one, null where unknown; pages has the same `key`. A page
    without an outcome takes its host's reputation, a host without any its domain's, and so on up. Null urls and urls without ://
    have an empty host and path and share the reputation of the empty host. Outcomes of the same key are combined to the worst, so
    repeated rows don't count twice. Empty tables give no rows; other columns are ignored.
    """
    named = pages.select(F.col(id_col).alias("page_id"), "key", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    worst = outcomes.filter("key is not null").groupBy("key").agg(F.max("bad").alias("bad"), F.lit(0).alias("spread"))
    # pages without a key meet no outcome; dealt out, they don't meet each other in one task either
    spread = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 16)).cast("int")).otherwise(0)
    judged = named.withColumn("spread", spread).join(worst, ["key", "spread"], "left")
    # written first, so that a host with many pages doesn't have to meet its reputation in one task
    known = materialize(reputations(judged.select("host", "bad")), "reputations")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("low") > MOST_BAD, "block").otherwise("allow")
    return named.join(known.select("host", "rate", "low"), "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, learned).alias("verdict"), "rate", "low")
