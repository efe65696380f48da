"""Unicode forms of all assigned characters, clusters, widths, and URLs by the standard's own cases."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F
from rankloom.functions import text as T
from rankloom.functions.columns import normal_query
from rankloom.functions.unicode import characters, graphemes, nfkc, nfkd, plain
from rankloom.functions.urls import http_url, normal, parse


@pytest.fixture(scope="module")
def assigned(spark):
    chars = [c for n in range(sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 and unicodedata.category(c := chr(n)) != "Cn"]
    return spark.createDataFrame([(c,) for c in chars], "c string").repartition(4)


def test_forms_of_all_assigned_characters(assigned):
    rows = assigned.select("c", nfkd(F.col("c")).alias("d"), nfkc(F.col("c")).alias("k"), plain(F.col("c")).alias("w")).collect()
    assert len(rows) > 280_000
    assert [r.c for r in rows if r.d != unicodedata.normalize("NFKD", r.c) or r.k != unicodedata.normalize("NFKC", r.c)] == []
    import regex

    assert [r.c for r in rows if r.w != regex.sub(r"[\p{Diacritic}\p{Mn}]", "", unicodedata.normalize("NFKD", r.c))] == []


def each(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normal_forms(spark):
    assert each(spark, T.normal_text, "½ ㎏ ﬃ", "각 한국", "Å\u3000Ａ\u00a0b", "ΌΣΟΣ", "it’s ´x`", None, "") == ["1⁄2 kg ffi", unicodedata.normalize("NFKD", "각 한국"), "a a b", "οσος", "it's x", None, ""]
    assert each(spark, normal_query, "  Ｆｏｏ\u00a0 ｶﾞ ", "e\u0301 ½", None) == ["foo ガ", "é 1⁄2", None]


def test_clusters(spark):
    texts = ["👨‍👩‍👧x", "🇩🇪🇫🇷", "각", "\u1112\u1161\u11abx", "e\u0301", "👍🏽!", "1️⃣", "\r\na", "", None]
    assert [None if g is None else len(g) for g in each(spark, graphemes, *texts)] == [2, 2, 1, 2, 1, 2, 1, 2, 0, None]


def test_widths_of_clusters(spark):
    texts = ["👨‍👩‍👧", "🇩🇪", "1️⃣", "한국", "\u1112\u1161\u11ab", "Ạ̈", "ø", "Ж", "\u200d", "A\u0301V", "©", "a\u3000b", "½"]
    assert each(spark, T.title_pixels, *texts) == [23.0, 23.0, 23.0, 40.0, 20.0, 13.3, 11.1, 11.1, 0.0, 25.1, 23.0, 27.8, 11.1]
    assert each(spark, T.title_confidence, "Plain é", "漢", "ø", "Ж", "") == ["high", "medium", "medium", "low", "high"]


def test_classes_by_ranges():
    assert characters(r"[a-c\u00e9]") == r"\x{61}-\x{63}\x{e9}"


#: The standard's cases for http(s) without a base, as (input, output); null where parsing fails. Credentials and fragments are left out.
CASES = [
    ("HTTP://EXAMPLE.com", "http://example.com/"), ("https://example.com:443/a", "https://example.com/a"), ("http://example.com:8080/", "http://example.com:8080/"), ("https:example.org", "https://example.org/"), ("https://////example.com///", "https://example.com///"),
    ("https://example.com/././foo", "https://example.com/foo"), ("https://example.com/../x", "https://example.com/x"), ("https://example.com/a/b/..", "https://example.com/a/"), ("https://example.com/a/%2e%2E/b", "https://example.com/b"), ("http://example.com/foo/%2e", "http://example.com/foo/"),
    ("http://example.com/foo/..bar", "http://example.com/foo/..bar"), ("https://example.com/é?q=é '#f", "https://example.com/%C3%A9?q=%C3%A9%20%27"), ("http:\\\\x:80\\a\\b", "http://x/a/b"), ("http://192.0x00A80001", "http://192.168.0.1/"), ("http://0300.0250.1", "http://192.168.0.1/"),
    ("http://256.256.256.256", None), ("http://1.2.3.4.5", None), ("http://0xffffffff", "http://255.255.255.255/"), ("http://4294967296", None), ("http://1.2.3.4.", "http://1.2.3.4/"), ("http://[::1]:80/", "http://[::1]/"), ("http://[1:2:0:0:5:0:0:0]/", "http://[1:2:0:0:5::]/"),
    ("http://[::127.0.0.1]", "http://[::7f00:1]/"), ("http://[::1", None), ("http://[::1%eth0]/", None), ("https://faß.ExAmPlE/", "https://xn--fa-hia.example/"), ("http://GOO\u200b\u2060\ufeffgoo.com", "http://googoo.com/"), ("http://www.foo。bar.com", "http://www.foo.bar.com/"),
    ("http://Ｇｏ.com", "http://go.com/"), ("http://你好你好", "http://xn--6qqa088eba/"), ("http://a b/", None), ("http://ex%41mple.com/", "http://example.com/"), ("http://a%00b/", None), ("http://%zz/", None), ("https://exa%23mple.org", None), ("http://user:p@ss@host/x", "http://host/x"),
    ("http://a:b@/x", None), ("http://host:/x", "http://host/x"), ("http://host:70000/", None), ("http://host:x/", None), ("http://host:0080/", "http://host/"), ("ftp://a/", None), ("mailto:x", None), ("", None), ("http://", None), ("  http://a/\t b\n ", "http://a/%20b"),
    ("http://foo.com/\ud7ff", "http://foo.com/%ED%9F%BF"), ("http://example.com/foo%", "http://example.com/foo%"), ("http://example.com/a^b`{}|~", "http://example.com/a%5Eb%60%7B%7D|~"), ("http://h?", "http://h/?"), ("http://1.2.0x.4", "http://1.2.0.4/"), ("http://foo.0x4", None),
    ("http://09.com", "http://09.com/"), ("http://foo.09", None), ("http://./", "http://./"), ("http://../", "http://../"), ("http://xn--a b", None),
]


def test_urls_by_the_standard(spark):
    assert [(u, normal(u)) for u, _ in CASES] == CASES
    assert each(spark, http_url, *[u for u, _ in CASES], None) == [w for _, w in CASES] + [None]


def test_normal_urls_stay():
    for _, url in CASES:
        assert url is None or normal(url) == url
    assert parse("https://u@h:8443/p?q#f") == ("https", "h", 8443, "/p", "q")
    assert normal("http://a/" + "../x/" * 200_000) == "http://a/x/"
