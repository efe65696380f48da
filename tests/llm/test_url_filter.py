from rankloom.llm import url_filter as U

PAGES = [
    (1, "https://A.Example.NET/en/x?q", 1), (2, "http://example.net/fr/", 2), (3, "http://example.net", 3), (4, "http://sub.example.com/de/1#top", 4), (5, "https://www.site.org/fr/2", 5),
    (6, "no scheme", 6), (7, None, None), (8, "http://bad.test/a", 8), (9, "http://bad.test/b", 9), (10, "http://good.test/", 10), (11, "http://new.test/", 11), (12, "x://h/p://q/r", 12), (13, "http://notexample.com/de/", 13), (13, "http://notexample.com/de/", 13),
]


def judged(spark, outcomes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, key long")
    return {r.page_id: r for r in U.judge_urls(pages, spark.createDataFrame(outcomes, "key long, bad int")).collect()}


def test_hosts_paths_and_rules(spark):
    rows = judged(spark, [])
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in rows.items()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3] == ("example.net", "", None, "allow")
    assert got[4] == ("sub.example.com", "/de/1", "example.com/de/", "block")
    assert got[5] == ("www.site.org", "/fr/2", "org/fr/", "allow")
    assert got[6][:2] == got[7][:2] == ("", "")
    assert got[12][:2] == ("h", "/p://q/r")
    assert got[13][2] is None


def test_reputation_shrinks_and_blocks(spark):
    many = [(i, "http://bad.test/%d" % i, i) for i in range(100, 160)] + [(i, "http://good.test/%d" % i, i) for i in range(200, 260)] + [(1, "http://bad.test/x", None), (2, "http://new.test/", None)]
    pages = spark.createDataFrame(many, "page_id long, url string, key long")
    outcomes = [(i, 1) for i in range(100, 160)] + [(i, 0) for i in range(200, 260)] + [(100, 1)] * 50
    rows = {r.page_id: r for r in U.judge_urls(pages, spark.createDataFrame(outcomes, "key long, bad int")).collect()}
    assert rows[1].verdict == "block" and rows[1].rate > 0.9
    assert rows[200].verdict == "allow" and rows[200].rate < 0.1
    assert 0.2 < rows[2].rate < 0.8  # nothing known of it: the rate of those above


def test_empty_tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, key long")
    none = spark.createDataFrame([], "key long, bad int")
    assert U.judge_urls(pages.limit(0), none).count() == 0
    assert U.judge_urls(pages, none).count() == len(PAGES)
