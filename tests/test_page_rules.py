"""Early exits of the audit rules, and clusters of queries, on small fixtures."""

import pytest
from pyspark.sql import functions as F
from rankloom.operators.graph import greedy_leaders
from rankloom.plans import page_rules
from rankloom.plans.crawl_reports import token_edges
from rankloom.sources.views import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def good(spark):
    """One page that breaks no rule but for duplicates."""
    page = page_rules.page_snapshots(table(spark, SF, "pages").limit(1))
    clean = {
        "url": F.lit("https://a.test/x"), "final_url": F.lit("https://a.test/x"), "status": F.lit(200), "blocked": F.lit(False), "inlinks": F.lit(5), "response_ms": F.lit(10), "hops": F.lit(0), "status_only": F.lit(False), "login_form": F.lit(False),
        "rendered": F.lit(False), "indexable": F.lit(True), "compressed": F.lit(True), "insecure_parts": F.lit(0), "hsts": F.lit(True), "broken_external": F.lit(0), "depth": F.lit(1), "robots_allowed": F.lit(True), "x_robots": F.lit(""), "meta_robots": F.lit(""),
        "canonical_raw": F.lit("https://a.test/x"), "canonical_status": F.lit("single"), "missing_alt": F.lit(0), "oversized": F.lit(False), "hreflang": F.lit(""), "invalid_json_ld": F.lit(0), "rich_missing": F.lit(False), "og_description": F.lit(True),
        "soft_missing": F.lit(False), "top_query": F.lit(""), "title": F.lit("A title"), "description": F.lit("What it says"), "n_h1": F.lit(1), "lang": F.lit("en"), "n_words": F.lit(100), "html_bytes": F.lit(1000), "viewport": F.lit(True), "og_title": F.lit(True),
        "og_image": F.lit(True), "twitter_card": F.lit(True), "json_ld": F.lit(True),
    }
    return page.withColumns(clean)


CASES = [
    ({}, []),
    ({"status": 0, "title": ""}, ["connection_error"]),
    ({"blocked": True, "status": 503}, ["crawler_access_blocked"]),
    ({"blocked": True, "status": 0}, ["connection_error"]),
    ({"status": 503}, ["broken_internal_link", "server_error"]),
    ({"status": 404, "inlinks": 0}, ["client_error"]),
    ({"status": 403}, ["client_error"]),
    ({"status": 301, "title": ""}, ["redirected_url"]),
    ({"hops": 2, "title": "", "response_ms": 2001}, ["redirect_chain", "redirected_url", "slow_response"]),
    ({"status_only": True, "title": ""}, []),
    ({"title": "", "n_h1": 2, "lang": ""}, ["h1_multiple", "lang_missing", "missing_title"]),
    ({"inlinks": 0, "clicks": 0, "impressions": 0, "sessions": 0}, ["orphan_page"]),
    ({"inlinks": 1, "clicks": 3}, ["weak_internal_links_to_valuable_page"]),
    ({"canonical_raw": "/y", "declared_other": False}, ["canonical_mismatch", "canonical_non_absolute"]),
    ({"canonical_raw": "", "canonical_status": "conflicting"}, ["canonical_conflict"]),
    ({"hreflang": "en,EN", "hreflang_self": True}, ["hreflang_duplicate"]),
    ({"rendered": True, "raw_chars": 100, "rendered_chars": 900, "n_words": 3}, ["client_rendered_content"]),
    ({"top_query": "how to mend the roof", "top_impressions": 60, "title": "Roof"}, ["query_coverage_missing"]),
]


def test_early_exits(spark, good):
    rows = None
    for i, (changed, _) in enumerate(CASES):
        # other titles, descriptions and contents, so that the cases aren't each other's duplicates
        own = {"page_id": F.lit(i), "url": F.lit(f"https://a.test/{i}"), "final_url": F.lit(f"https://a.test/{i}"), "content_hash": F.lit(str(i)), "description": F.lit(f"d{i}"), "text": F.lit("")}
        own |= {"title": F.lit(f"Title {i}")} | ({"canonical_raw": F.lit(f"https://a.test/{i}")}) | {k: F.lit(v) for k, v in changed.items()}
        page = good.withColumns(own)
        rows = page if rows is None else rows.unionByName(page)
    found = {}
    for r in page_rules.findings(rows).collect():
        found.setdefault(r.page_id, []).append(r.rule)
    assert {i: sorted(found.get(i, [])) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def clusters(spark, queries):
    rows = spark.createDataFrame([(q, len(queries) - i) for i, q in enumerate(queries)], "query string, impressions int")
    rank = F.struct((-F.col("impressions")).alias("order"), F.col("query").alias("name"))
    found = greedy_leaders(rows.select(F.col("query").alias("node"), rank.alias("rank")), token_edges(rows.select("query")))
    return {r.node: r.leader for r in found.collect()}


def test_related_queries_make_one_cluster(spark):
    got = clusters(spark, ["how to sharpen knives 2031", "sharpen knives 2031", "sharpen knives guide 2031", "cutlery stores"])
    assert len({got[q] for q in got if "knives" in q}) == 1 and got["cutlery stores"] == "cutlery stores"


def test_common_terms_do_not_join(spark):
    got = clusters(spark, [f"rent noise {i:03}" for i in range(300)] + ["average studio rent oslo", "studio rent oslo cost"])
    assert got["studio rent oslo cost"] == "average studio rent oslo"
    assert len(set(got.values())) == 301


def test_a_chain_settles(spark):
    """A long chain of alike queries settles, whatever the number of rounds."""
    nodes = spark.createDataFrame([(i, i) for i in range(60)], "node long, rank long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(59)], "a long, b long")
    got = {r.node: r.leader for r in greedy_leaders(nodes, edges).collect()}
    assert got == {i: i if i % 2 == 0 else i - 1 for i in range(60)}


def test_url_patterns(spark):
    urls = ["https://a.test/en/x", "https://a.test/de/en", "https://b.test/50%_off"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    match = lambda p: [r.u for r in rows.filter(page_rules.url_like(F.col("u"), p)).collect()]
    assert match("a.test*/en") == urls[:2] and match("0%_o") == urls[2:] and match("*") == urls and match("x*a.test") == []


def test_reports_look_at_their_own_rules_only(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from rankloom.plans import page_rules

    pages = spark.createDataFrame([(i, f"https://a.test/{i}", f"<html><head><title>t{i}</title></head><body><h1>x</h1></body></html>") for i in range(40)], "page_id long, url string, html string")
    snapshots = page_rules.page_snapshots(pages)
    key = lambda df: sorted((r.page_id, r.rule) for r in df.collect())
    every = [x for x in key(page_rules.findings(snapshots)) if x[1] in page_rules.FIXES]
    pages.write.parquet(f"{tmp_path}/pages.parquet")

    monkeypatch.setattr(page_rules.T, "title_pixels", lambda title: F.raise_error(F.lit("the width of titles is no fix")).cast("double"))
    assert every and key(page_rules.findings(snapshots, only=page_rules.FIXES)) == every
    for report in (page_rules.affected_urls, page_rules.top_fixes, page_rules.agent_readiness):
        assert report(spark, str(tmp_path)).collect()
