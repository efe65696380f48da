from rankloom.sources import views as V


def test_combined_log(spark):
    lines = [
        '10.9.8.7 - anna [03/Feb/2024:08:01:02 +0200] "GET /shelf/7?page=2 HTTP/2.0" 206 4711 "https://lib.test/" "Mozilla/5.0 (compatible; bingbot/2.0)"', 'h7 - - [03/Feb/2024:08:01:02 +0000] "PUT https://lib.test/loan/ HTTP/1.1" 502 -', "nonsense", "",
        'h7 - - [44/Feb/2024:08:01:02 +0000] "GET / HTTP/1.1" 200 1 "-" "CCBot"', 'h7 - - [03/Feb/2024:08:01:02 +0000] "GET / HTTP/1.1" 999 1 "-" "CCBot"',
    ]
    rows = V.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.valid for r in rows] == [True, True, False, False, False, False]
    assert (rows[0].path, rows[0].status, rows[0].bytes, rows[0].family, rows[0].category) == ("/shelf/7", 206, 4711, "Bingbot", "search")
    assert rows[0].ts.isoformat() == "2024-02-03T06:01:02"
    assert (rows[1].path, rows[1].bytes, rows[1].family) == ("/loan/", None, None)


def test_json_log(spark):
    lines = ['{"@timestamp": "2025-10-10T13:55:36Z", "requestMethod": "GET", "requestUri": "/a", "status": 200, "userAgent": "GPTBot"}', '{"time": "2025-10-10T13:55:36Z", "path": "/b", "statusCode": "404"}', "broken"]
    rows = V.parse_json_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.method, r.path, r.status) for r in rows] == [("GET", "/a", 200), (None, "/b", 404), (None, None, None)]


def test_search_export(spark, tmp_path):
    (tmp_path / "pages.csv").write_text('Top pages,Clicks,Impressions,CTR,Position\nhttps://lib.test/,"6,250","25,000",25%,1.5\nhttps://lib.test/,3,12,25%,8\nhttps://shelf.test/,-,7,0%,1\n')
    rows = {r.page: r for r in V.search_export(V.read_csv_export(spark, str(tmp_path / "pages.csv"))).collect()}
    assert (rows["https://lib.test/"].clicks, rows["https://lib.test/"].impressions) == (6250.0, 25000.0)
    assert rows["https://shelf.test/"].clicks is None  # missing isn't zero


def test_backlinks(spark, tmp_path):
    (tmp_path / "links.csv").write_text('Source URL,Target URL,Anchor Text,Nofollow\nhttps://lib.test/new,https://shelf.test/,"old books, maps\nand prints",yes\nhttps://lib.test/new,https://shelf.test/,"old books, maps\nand prints",no\nmailto:x,https://shelf.test/,x,\nhttps://maps.test/,https://shelf.test/,,\n')
    rows = sorted(map(tuple, V.backlinks(V.read_csv_export(spark, str(tmp_path / "links.csv"), multi_line=True)).collect()))
    assert rows == [("https://lib.test/new", "https://shelf.test/", "old books, maps\nand prints", True), ("https://maps.test/", "https://shelf.test/", "", False)]


def test_rates_are_null_without_impressions(spark):
    rows = spark.createDataFrame([("a", 0, 0, 5), ("b", 10, 1, 2), ("b", 30, 3, 4)], "query string, impressions long, clicks long, position long")
    got = {r.query: r for r in V.aggregate_rows(rows, "query").collect()}
    assert got["a"].ctr is None and got["a"].position is None
    assert (got["b"].ctr, got["b"].position, got["b"].n_rows) == (0.1, 3.5, 2)
