from rankloom.sources.views import access_log
from rankloom.streaming import logs as L

SF = "/root/testdata/sf0.001"


def run(query, mode):
    q = query.writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.table("out")


def test_streams_match_the_batch(spark, tmp_path):
    from rankloom.plans.log_reports import log_crawlers, status_histogram

    access_log(spark, SF).repartition(6).write.text(str(tmp_path / "log"))
    stream = L.log_stream(spark, str(tmp_path / "log"), 2)
    got = {r.family: r.requests for r in run(L.crawler_totals(stream), "complete").collect()}
    assert got == {r.family: r.requests for r in log_crawlers(spark, SF).collect()}
    windows = run(L.windowed_statuses(stream, late="60 days"), "complete").groupBy("status").sum("requests").collect()
    assert {r[0]: r[1] for r in windows} == {r.status: r.requests for r in status_histogram(spark, SF).collect()}
    assert run(L.first_seen(stream, "60 days"), "append").count() == len({(r.family, r.path) for r in stream_pairs(spark)})


def stream_pairs(spark):
    from rankloom.plans.log_reports import crawler_paths

    return crawler_paths(spark, SF).select("family", "path").collect()


def test_sessions(spark, tmp_path):
    rows = spark.sql("SELECT user_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (1, 0), (1, 20), (1, 90), (2, 5) AS t(user_id, m)")
    rows.write.parquet(str(tmp_path / "e"))
    got = run(L.sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), late="10 days"), "complete")
    assert sorted((r.user_id, r.n_events) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
