import pytest
from rankloom.sources import exports as E


def test_delimiters_and_encodings():
    assert [E.delimiter_of(h) for h in ("a;b;c", 'x,"a;b;c;d",y', "a\tb", "a|b|c,d", "one")] == [";", ",", "\t", "|", ","]
    assert [E.encoding_of(b) for b in (b"\xff\xfea\x00", b"\xfe\xff\x00a", b"\xef\xbb\xbfa", b"")] == ["UTF-16LE", "UTF-16BE", "UTF-8", "UTF-8"]
    with pytest.raises(ValueError, match="UTF-32"):
        E.encoding_of(b"\xff\xfe\x00\x00")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"])
def test_exports_of_any_encoding(spark, tmp_path, encoding):
    text = 'Keyword;Rank\n"a; b";1\nÄ;2\n'
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(encoding, b"")
    (tmp_path / "x.csv").write_bytes(mark + text.encode(encoding))
    rows = E.read_export(spark, str(tmp_path / "x.csv"))
    assert rows.columns == ["Keyword", "Rank"] and [tuple(r) for r in rows.collect()] == [("a; b", "1"), ("Ä", "2")]


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    assert [tuple(r) for r in E.read_json_array(spark, str(tmp_path / "l.json"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    rows = spark.createDataFrame([('say "hi", all', None, [1, 2]), ("", "x\ny", [])], "a string, b string, c array<int>")
    E.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    back = E.read_export(spark, str(tmp_path / "out"), multi_line=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([('say "hi", all', None, "[1,2]"), (None, "x\ny", "[]")], key=str)


def test_files_of_a_folder_are_read_each_in_its_own_way(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k;v\n1;x\n".encode("utf-16-le").join([b"\xff\xfe", b""]))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfv\tk\r\ny,\t2\r\n")
    (tmp_path / "c.csv").write_text("k,other\n3,z\n")
    (tmp_path / "d.csv").write_text("k;v\n4;\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.csv").write_text("")
    rows = E.read_export(spark, str(tmp_path))
    assert set(rows.columns) == {"k", "v", "other"}
    assert sorted((r.k, r.v, r.other) for r in rows.collect()) == [("1", "x", None), ("2", "y,", None), ("3", None, "z"), ("4", None, None)]
    (tmp_path / "none").mkdir()
    assert E.read_export(spark, str(tmp_path / "none")).columns == []


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n" + "".join(f"{i},{i * 7}\n" for i in range(300_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = E.read_export(spark, str(tmp_path / "x.csv"))
        assert rows.rdd.getNumPartitions() > 2 and rows.count() == 300_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
