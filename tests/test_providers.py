"""A provider's files by day, broken lines, limits; and JSON at its bounds."""

import json

import pytest
from pyspark.sql import functions as F
from rankloom.sources import providers


@pytest.fixture
def files(tmp_path):
    def make(**days):
        for day, lines in days.items():
            folder = tmp_path / f"date={day[1:].replace('_', '-')}"
            folder.mkdir()
            for i, part in enumerate(lines):
                (folder / f"part-{i}.json").write_bytes("\n".join(part).encode())
            (folder / "_SUCCESS").write_bytes(b"")
            (folder / ".part.crc").write_bytes(b"x")
        return str(tmp_path)

    return make


def visit(page, n):
    return json.dumps({"page": page, "visits": n, "other": 1})


def rows(spark, path, **options):
    providers.register(spark)
    return spark.read.format("landing_page_visits").options(**options).load(path)


def test_days_files_and_broken_lines(spark, files):
    path = files(
        d2024_01_01=[[visit("/a", 1), "", "{", "[1]", "null", visit("", 1), visit("/a", -1), visit("/a", 1.5), visit("/a", True), '{"page":"/é","visits":2}'], [visit("/b", 0)]],
        d2024_01_02=[[visit("/a", 5)]], d2024_02_01=[[visit("/z", 9)], []],
    )
    got = rows(spark, path, startDate="2024-01-01", endDate="2024-01-31")
    assert got.rdd.getNumPartitions() == 3  # a partition for each file of these days
    assert sorted((str(r.date), r.page, r.visits) for r in got.filter("valid").collect()) == [("2024-01-01", "/a", 1), ("2024-01-01", "/b", 0), ("2024-01-01", "/é", 2), ("2024-01-02", "/a", 5)]
    assert got.filter("NOT valid").count() == 8
    assert rows(spark, f"file:{path}").count() == 13 and rows(spark, f"file://{path}").count() == 13
    assert rows(spark, path, startDate="2030-01-01").count() == 0


def test_wrong_options(spark, files):
    with pytest.raises(Exception, match="startDate is after"):
        rows(spark, files(d2024_01_01=[[]]), startDate="2024-02-01", endDate="2024-01-01").count()


def test_summaries(spark):
    data = spark.createDataFrame([("2024-01-01", "/a", 3, True), ("2024-01-01", "/a", 1, True), ("2024-01-02", "/a", 9, True), ("2024-01-01", None, None, False)], "date string, page string, visits long, valid boolean").withColumn("date", F.to_date("date"))
    assert tuple(providers.visits_summary(data, 1).first()) == (4, 1, 2, 1, 9, True, "partial")
    assert tuple(providers.visits_summary(data.filter("valid"), 2).first()) == (3, 0, 2, 2, 13, False, "complete")
    assert tuple(providers.visits_summary(data.limit(0), 2).first()) == (0, 0, 0, 0, 0, False, "complete")


def nested(depth):
    return '{"a":' * depth + "1" + "}" * depth


@pytest.mark.parametrize(
    ("text", "reason"),
    [(None, "null"), ("", "json"), ("{", "json"), ("[]", "object"), ("5", "object"), (nested(17), "depth"), ("[" * 100_000, "bytes"), (json.dumps({"a": "x" * 8193}), "text"), (json.dumps({"a" * 257: 1}), "entries"), (json.dumps({str(i): 1 for i in range(1001)}), "entries"),
     (json.dumps({"a": [[0] * 900] * 6}), "values"), ('{"a": NaN}', "number"), ('{"a": 1e999}', "number"), ('{"' + "é" * 33_000 + '":1}', "bytes")],
)
def test_refused_objects(text, reason):
    assert providers.json_rows(text) == [(None, "refused", reason)]


def test_values_in_order(spark):
    text = '{"b": {"x": [1.5, "t", null]}, "a": false}'
    want = [("$", "object", None), ("$.b", "object", None), ("$.b.x", "array", None), ("$.b.x[0]", "number", "1.5"), ("$.b.x[1]", "string", "t"), ("$.b.x[2]", "null", None), ("$.a", "boolean", "false")]
    assert providers.json_rows(text) == want
    assert len(providers.json_rows(nested(16))) == 17 and len(providers.json_rows(json.dumps({"a": "x" * 8192}))) == 2
    providers.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM json_values(:t)", {"t": text}).collect()] == want
