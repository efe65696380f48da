"""Click-through benchmarks per position, each page's own rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import curve_ctr, page_key, round_half_up, rounded_position
from .ranks import ranked
from .tables import written

#: A page's rows at a position count from so many impressions; a position is judged by the site's own rates from so much evidence.
LEAST_URL_IMPRESSIONS, LEAST_IMPRESSIONS, LEAST_URLS, LEAST_POSITIVE = 30, 1000, 5, 3
#: The site's rate is kept within these multiples of the common curve.
LOWEST, HIGHEST = 0.5, 1.5


def _target(site_ctr: Column, curve: Column) -> Column:
    """The site's rate within LOWEST and HIGHEST of the curve; the curve itself where the site has none (least() would skip the null)."""
    kept = F.greatest(curve * LOWEST, F.least(site_ctr, curve * HIGHEST))
    return round_half_up(F.when(site_ctr.isNotNull(), kept).otherwise(curve), 4)


def leave_url_out(rows: DataFrame, all_qualified: bool = False) -> DataFrame:
    """url_key, bucket, target, own: the rate that a page should reach at each position 1 to 10.

    rows: page, clicks, impressions, position. The target is the 75th percentile (nearest rank) of the rates of the other pages at the
    same rounded position, within LOWEST and HIGHEST of the curve, and never rises with the position; the curve where evidence is thin.
    A page is left out by shifting the rank that is looked up, so every bucket is sorted once and no page is compared with all others.
    """
    keyed = rows.select(page_key(F.col("page")).alias("url_key"), rounded_position(F.col("position")).alias("bucket"), "clicks", "impressions")
    # one small table that all that follows reads
    pages = written(keyed.groupBy("url_key", "bucket").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")), "page-positions")
    urls = pages.filter(F.col("impressions") >= LEAST_URL_IMPRESSIONS).withColumn("ctr", F.col("clicks").cast("double") / F.col("impressions"))
    positive = F.col("clicks") > 0
    totals = urls.groupBy("bucket").agg(F.sum("impressions").alias("all_impressions"), F.count("*").alias("n_all"), F.count_if(positive).alias("n_positive"))
    sampled = urls if all_qualified else urls.filter(positive)
    # ten buckets hold all pages, so their places are counted over ranges
    places = ranked(sampled, ["bucket"], [F.col("ctr"), F.col("url_key")], "place").withColumn("place", F.col("place") - 1)

    buckets = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("bucket")
    targets = pages.select("url_key").distinct().select("url_key", buckets)
    own = urls.select("url_key", "bucket", F.col("impressions").alias("own_impressions"), positive.cast("int").alias("own_positive"))
    place = places.select("url_key", "bucket", F.col("place").alias("own_place"))
    t = targets.join(own, ["url_key", "bucket"], "left").join(place, ["url_key", "bucket"], "left").join(F.broadcast(totals), "bucket", "left")  # ten rows
    has = F.col("own_impressions").isNotNull().cast("int")
    enough = (F.col("all_impressions") - F.coalesce("own_impressions", F.lit(0)) >= LEAST_IMPRESSIONS) & (F.col("n_all") - has >= LEAST_URLS) & (F.col("n_positive") - F.coalesce("own_positive", F.lit(0)) >= LEAST_POSITIVE)
    size = (F.col("n_all") if all_qualified else F.col("n_positive")) - F.col("own_place").isNotNull().cast("int")
    rank = F.ceil(size * 0.75) - 1
    at = (rank + F.coalesce((rank >= F.col("own_place")).cast("int"), F.lit(0))).cast("int").alias("place")
    t = t.select("url_key", "bucket", F.when(F.coalesce(enough, F.lit(False)), at).alias("place"))
    # a page is left out by a rank one further at most, so two rates of a bucket are all that is looked up
    looked_up = F.broadcast(t.filter("place is not null").select("bucket", "place").distinct())  # twenty rows at most
    rates = places.join(looked_up, ["bucket", "place"]).select("bucket", "place", F.col("ctr").alias("site_ctr"))
    curve = curve_ctr(F.col("bucket"))
    t = t.join(F.broadcast(rates), ["bucket", "place"], "left").withColumn("raw", _target(F.col("site_ctr"), curve))
    so_far = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return t.select("url_key", "bucket", F.min("raw").over(so_far).alias("target"), F.col("site_ctr").isNotNull().alias("from_site"))


def leave_group_out(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, bucket, target, from_site: the rate to reach at each position 1 to 10 when the rows of a group don't count.

    rows: query, page, clicks, impressions, position. groups: grp, query, page. The pages of a group lose its rows and are judged anew; all
    others keep their place in the order of rates. The 75th percentile then lies so near its old place that as many rates as the group has
    pages are looked up, never the whole bucket. Groups of one row each are the benchmark that leaves out a row.
    """
    c, n = F.col, F.lit
    keyed = written(rows.select("query", "page", page_key(c("page")).alias("url_key"), rounded_position(c("position")).alias("bucket"), "clicks", "impressions"), "rows")
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    urls = sums(keyed, "url_key", "bucket")
    rate = c("clicks").cast("double") / c("impressions")
    qualified = urls.filter(c("impressions") >= LEAST_URL_IMPRESSIONS).withColumn("ctr", rate)
    totals = qualified.groupBy("bucket").agg(F.sum("impressions").alias("all_impressions"), F.count("*").alias("n_all"), F.count_if(c("clicks") > 0).alias("n_positive"))
    places = ranked(qualified.filter("clicks > 0"), ["bucket"], [c("ctr"), c("url_key")], "place").withColumn("place", c("place") - 1)

    own = sums(keyed.join(groups, ["query", "page"]), "grp", "bucket", "url_key").withColumnsRenamed({"clicks": "own_clicks", "impressions": "own_impressions"})
    left = own.join(urls, ["bucket", "url_key"]).withColumns({"left_clicks": c("clicks") - c("own_clicks"), "left_impressions": c("impressions") - c("own_impressions")})
    was, now = c("impressions") >= LEAST_URL_IMPRESSIONS, c("left_impressions") >= LEAST_URL_IMPRESSIONS
    left = written(left.withColumns({"was": was, "now": now, "was_positive": was & (c("clicks") > 0), "now_positive": now & (c("left_clicks") > 0)}), "without-groups")
    one = lambda x: F.sum(c(x).cast("long"))
    change = left.groupBy("grp", "bucket").agg(
        (F.sum(F.when(c("now"), c("left_impressions")).otherwise(0)) - F.sum(F.when(c("was"), c("impressions")).otherwise(0))).alias("d_impressions"),
        (one("now") - one("was")).alias("d_all"), one("was_positive").alias("gone"), one("now_positive").alias("come"),
    )
    cells = groups.select("grp").distinct().select("grp", F.explode(F.sequence(n(1), n(10))).alias("bucket"))
    cells = cells.join(change, ["grp", "bucket"], "left").join(F.broadcast(totals), "bucket", "left").fillna(0)  # ten rows
    positive = c("n_positive") - c("gone") + c("come")
    enough = (c("all_impressions") + c("d_impressions") >= LEAST_IMPRESSIONS) & (c("n_all") + c("d_all") >= LEAST_URLS) & (positive >= LEAST_POSITIVE)
    k = F.ceil(positive * 0.75) - 1
    cells = cells.select("grp", "bucket", enough.alias("enough"), k.alias("k"), F.greatest(n(0), k - c("come")).alias("lo"), F.least(c("n_positive") - 1, k + c("gone")).alias("hi"))

    removed = left.filter("was_positive").select("grp", "bucket", "url_key").join(places.select("bucket", "url_key", "place"), ["bucket", "url_key"]).select("grp", "bucket", "place")
    below = removed.join(cells, ["grp", "bucket"]).filter("place < lo").groupBy("grp", "bucket").agg(F.count("*").alias("below"))
    near = cells.filter("enough and hi >= lo").select("grp", "bucket", F.explode(F.sequence("lo", "hi")).alias("place")).join(removed, ["grp", "bucket", "place"], "left_anti")
    near = near.join(places.select("bucket", "place", "ctr", "url_key"), ["bucket", "place"]).select("grp", "bucket", "ctr", "url_key")
    new = left.filter("now_positive").select("grp", "bucket", (c("left_clicks").cast("double") / c("left_impressions")).alias("ctr"), "url_key")
    order = F.row_number().over(W.partitionBy("grp", "bucket").orderBy("ctr", "url_key")) - 1  # as many rates as the group has pages
    sought = cells.filter("enough").join(below, ["grp", "bucket"], "left").select("grp", "bucket", (c("k") - c("lo") + F.coalesce("below", n(0))).alias("at"))
    rates = near.union(new).withColumn("at", order).join(sought, ["grp", "bucket", "at"]).select("grp", "bucket", c("ctr").alias("site_ctr"))
    curve = curve_ctr(c("bucket"))
    t = cells.select("grp", "bucket").join(rates, ["grp", "bucket"], "left").withColumn("raw", _target(c("site_ctr"), curve))
    so_far = W.partitionBy("grp").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return t.select("grp", "bucket", F.min("raw").over(so_far).alias("target"), c("site_ctr").isNotNull().alias("from_site"))


def benchmark_sql(rows: str, all_qualified: bool) -> str:
    """The same as CTEs that end in `bench`, over the CTE `rows` (page, clicks, impressions, position)."""
    sampled = "TRUE" if all_qualified else "clicks > 0"
    curve = "[0.27, 0.15, 0.10, 0.07, 0.05, 0.035, 0.025, 0.02, 0.015, 0.012][{0}::INT]::DOUBLE"
    return f"""
b_urls AS (
  SELECT regexp_replace(page, '/+$', '') AS url_key, greatest(1, least(10, floor(position + 0.5)))::INT AS bucket, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions
  FROM {rows} GROUP BY 1, 2 HAVING sum(impressions) >= 30),
b_totals AS (SELECT bucket, sum(impressions) AS all_impressions, count(*) AS n_all, count(*) FILTER (WHERE clicks > 0) AS n_positive FROM b_urls GROUP BY 1),
b_targets AS (SELECT url_key, bucket FROM (SELECT DISTINCT regexp_replace(page, '/+$', '') AS url_key FROM {rows}), (SELECT unnest(range(1, 11))::INT AS bucket)),
b_raw AS (
  SELECT t.url_key, t.bucket, (
    SELECT quantile_disc(o.clicks::DOUBLE / o.impressions, 0.75) FROM b_urls o WHERE o.bucket = t.bucket AND o.url_key <> t.url_key AND {sampled.replace('clicks', 'o.clicks')}) AS p75,
    coalesce(s.all_impressions - coalesce(u.impressions, 0) >= 1000 AND s.n_all - (u.bucket IS NOT NULL)::INT >= 5 AND s.n_positive - coalesce((u.clicks > 0)::INT, 0) >= 3, FALSE) AS enough
  FROM b_targets t LEFT JOIN b_totals s ON s.bucket = t.bucket LEFT JOIN b_urls u ON u.url_key = t.url_key AND u.bucket = t.bucket),
b_kept AS (
  SELECT url_key, bucket, enough AND p75 IS NOT NULL AS from_site, {curve.format('bucket')} AS curve, CASE WHEN enough THEN p75 END AS p75 FROM b_raw),
bench AS (
  SELECT url_key, bucket, from_site, min(floor(CASE WHEN p75 IS NULL THEN curve ELSE greatest(curve * 0.5, least(p75, curve * 1.5)) END * 10000 + 0.5) / 10000)
    OVER (PARTITION BY url_key ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS target FROM b_kept)"""
