"""The token stream against the standard library's parser, scopes against a tree, and pages worked out by hand."""

import random
from html.parser import HTMLParser

import pytest
from rankloom.functions.html import FIELDS, GROUPS, VALUES, VOID, _clean, extracted, json_items, page_facts, schema_types, tokens
from rankloom.sources.views import table


class Plain(HTMLParser):
    """Tokens as the standard library sees them; text in one piece."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.out.append(("start", tag, first))

    def handle_endtag(self, tag):
        self.out.append(("end", tag, {}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.out and self.out[-1][0] == "text":
            self.out[-1] = ("text", self.out[-1][1] + data, {})
        else:
            self.out.append(("text", data, {}))


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    return parser.out


def ours(html):
    out = []
    for t in tokens(html):
        if t[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + t[1], {})
        else:
            out.append(t)
    return out


RNG = random.Random(8)


def attribute():
    name = RNG.choice(["itemprop", "ITEMSCOPE", "itemtype", "href", "content", "class", "data-x", "itemid", "datetime", "src"])
    value = RNG.choice(["name", "offers sameAs", "https://schema.org/Thing", "a &amp; b", "x>y", "", "é"])
    return RNG.choice([f'{name}="{value}"', f"{name} = '{value}'", name, f"{name}={value.replace(' ', '').replace('>', '') or 'z'}"])


def page():
    parts = []
    for _ in range(RNG.randrange(40)):
        tag = RNG.choice(["div", "p", "li", "span", "meta", "br", "a", "time", "td", "tr", "img", "B"])
        start = f"<{tag} {' '.join(attribute() for _ in range(RNG.randrange(4)))}>"
        parts.append(RNG.choice([start, start, start, f"</{tag}>", f"</{tag} >", "text &lt;b&gt; ", "<!-- <div itemscope> -->", "<script>if (a<b) '</p>'</script>", "<style>p > a {}</style>", "\n", "5 < 6 ", "<!DOCTYPE html>"]))
    return "".join(parts)


def test_tokens_against_the_standard_library():
    for _ in range(400):
        html = page()
        assert ours(html) == plain(html), html


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


def tree(html):
    at = root = Node("", {}, None)
    raw = False
    for kind, name, attrs in plain(html):
        if kind == "text":
            if not raw:
                at.children.append(name)
        elif kind == "start":
            raw = name in ("script", "style")
            while at.parent and at.tag in GROUPS.get(name, ()):
                at = at.parent
            at.children.append(Node(name, attrs, at))
            at = at if name in VOID else at.children[-1]
        else:
            raw = False
            up = at
            while up.parent and up.tag != name:
                up = up.parent
            at = up.parent if up.parent else at
    return root


def microdata(node, item=None, found=None):
    """(types, id, props) of every item, by walking the tree."""
    found = [] if found is None else found
    for c in node.children:
        if isinstance(c, str):
            continue
        names, inner = c.attrs.get("itemprop", "").split(), item
        if "itemscope" in c.attrs:
            inner = (schema_types(c.attrs.get("itemtype", "")), c.attrs.get("itemid"), {})
            found.append(inner)
            for n in names if item else []:
                item[2].setdefault(n, "item")
        elif names and item:
            value = c.attrs.get("content", c.attrs.get(VALUES.get(c.tag, ""), None))
            value = ("" if c.tag in VOID else _clean(c.text())) if value is None else value
            for n in names:
                if value.strip():
                    item[2].setdefault(n, value)
        microdata(c, inner, found)
    return found


def test_scopes_against_a_tree():
    n_items = 0
    for _ in range(400):
        html = page()
        want = microdata(tree(html))
        got = [x for x in page_facts(html)["items"] if x["format"] == "microdata"]
        assert [(x["types"], x["id"]) for x in got] == [(t, i) for t, i, _ in want]
        # texts are complete only when their element ends, so the first of a property may come later than another one of it
        assert [set(x["props"]) for x in got] == [set(p) for _, _, p in want], html
        n_items += len(got)
    assert n_items > 200


def test_a_page_by_hand():
    html = """<!doctype html><HTML LANG='de'><head><title> A &amp;\n B </title><title>no</title><meta CONTENT="d" name='Description'><meta name=robots content=noindex><meta name=ROBOTS content="nofollow">
      <link href="/c" rel="nofollow canonical"><link rel=alternate hreflang=en href=/en><link rel="stylesheet" href="http://x/s.css"><meta property="og:title"></head>
      <body><nav>menu <a href=/n>n</a></nav><h1>T</h1><p>one<p>two <img src="http://x/i.png"><img alt src=i><a rel="x NoFollow" href="/l?a=1&amp;b=2">L <b>k</b></a><footer>f</footer>
      <form action='https://a.test/x/sign-in?n=1'><input type=PassWord></form></body>"""
    f = page_facts(html, "https://a.test/")
    assert (f["title"], f["description"], f["lang"], f["n_h1"], f["text"], f["n_words"]) == ("A & B", "d", "de", 1, "T one two L k", 5)
    assert (f["canonical"], f["canonical_status"], f["meta_robots"], f["alternates"]) == ("/c", "single", "noindex,nofollow", [{"lang": "en", "href": "/en"}])
    assert f["links"] == [{"href": "/n", "text": "n", "nofollow": False}, {"href": "/l?a=1&b=2", "text": "L k", "nofollow": True}]
    assert (f["missing_alt"], f["insecure_parts"], f["login_form"], f["og_title"], f["og_image"]) == (1, 2, True, True, False)


@pytest.mark.parametrize(
    ("links", "status", "first"),
    [("", "single", ""), ("<link rel=canonical href=/a>", "single", "/a"), ("<link rel=canonical href=/a><link rel=canonical href=/a>", "duplicate", "/a"), ("<link rel=canonical href=/a><link rel=canonical href=/b>", "conflicting", "/a"),
     ("<body><link rel=canonical href=/a>", "outside-head-only", "/a"), ("<link rel=canonical href=/a><body><link rel=canonical href=/b>", "single", "/a")],
)
def test_canonicals(links, status, first):
    f = page_facts(f"<html><head>{links}")
    assert (f["canonical_status"], f["canonical"]) == (status, first)


def test_login_gates_need_more_than_a_password():
    form = "<form><input type=password></form>"
    assert not page_facts(form, "https://a.test/shop")["login_form"]
    assert page_facts(form, "https://a.test/en/login?x")["login_form"]
    assert page_facts(f"<title>Please sign in</title>{form}", "https://a.test/")["login_form"]
    assert not page_facts("<title>Sign in</title><input type=password>", "https://a.test/login")["login_form"]


def test_json_ld_of_all_shapes():
    assert json_items("{") is None and json_items("5") == [] and json_items("") is None
    found = json_items('[{"@context": ["https://other.test/x", {"s": {"@id": "https://schema.org/"}}], "@type": "s:Thing", "a": {"b": [{"@type": "https://www.schema.org/Place", "name": "P"}]}}, {"@type": "Thing"}]')
    assert [(x["path"], x["types"]) for x in found] == [("$[0]", ["Thing"]), ("$[0].a.b[0]", ["Place"])]
    assert json_items('{"@type":"Thing","x":' * 3000 + "1" + "}" * 3000) in (None, [])


def test_awkward_pages():
    assert page_facts("")["text"] == "" and page_facts("<")["text"] == "<" and page_facts("a <b")["text"] == "a"
    assert page_facts("<title>never ends")["title"] == "never ends" and page_facts("x<!-- never ends")["text"] == "x"
    deep = "<div itemscope itemprop=a>" * 5000 + "x" + "</div>" * 5000
    assert len(page_facts(deep)["items"]) == 5000
    long = "<p>" + "word " * 500_000
    assert page_facts(long)["n_words"] == 500_000
    assert page_facts("<p " * 20_000)["text"] == ""
    assert page_facts('<a href="x>' * 20_000)["text"] == ""


def test_tables_of_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<title>t</title>", 7), (1, "u", "<title>t</title>", 7), (2, None, None, 8), (3, "u", "", 9)], "page_id long, url string, html string, title int")
    got = sorted((r.page_id, r.title, r.n_words, r.canonical_status) for r in extracted(rows, "page_id").collect())
    assert got == [(1, "t", 0, "single"), (1, "t", 0, "single"), (2, "", 0, "single"), (3, "", 0, "single")]
    assert extracted(rows.limit(0), "page_id").columns == ["page_id", *FIELDS] and extracted(rows.limit(0), "page_id").count() == 0


def test_the_html_is_read_once(spark):
    from rankloom.plans import page_rules

    found = page_rules.findings(page_rules.page_snapshots(table(spark, "/root/testdata/sf0.001", "pages")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # what was read is a written table


def test_crawl_reports_read_entities_as_their_sql(spark, tmp_path):
    import duckdb
    from rankloom.plans import crawl_reports

    titles = ["a &amp; b&amp", "&quot;quoted&quot; &lt;b", "  two  spaces ", "caf&eacute; &copy &#x27;x&#39;", "&amp;lt; a\u00a0b", "a &amp; b&amp", "A &amp; B&", None, "line\nbreak"]
    page = lambda t: "" if t is None else f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1><p>x &amp;amp; {t} &nbsp;\u2003y</p></body></html>'
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(i, "https://a.test/", page(t)) for i, t in enumerate(titles)], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
        for name in ("crawl_pages", "duplicate_metadata", "coverage_ratios"):
            want = con.execute(crawl_reports.ORACLE_SQL[name]).fetchall()
            assert sorted(map(tuple, crawl_reports.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want), name


def test_duplicate_titles_are_trimmed_and_lowered_as_their_sql(spark, tmp_path):
    """Spaces of Unicode at the ends are no part of a title; a sigma at a word's end is no letter of its own."""
    import duckdb
    from rankloom.plans import crawl_reports

    titles = ["Nouveautés\u00a0", "nouveautés", "\u2003\u3000NouveautÉs \u202f", "\u200bnouveautés", "ΟΔΟΣ", "οδοσ", "οδος", "Οδος", "\u0130zmir", "izmir", "i\u0307zmir", "\u00a0", "\u00a0", "\ttab", "tab"]
    path = f"{tmp_path}/pages.parquet"
    rows = [(i, "https://a.test/", f"<html lang=\"en\"><head><title>{t}</title></head><body>\u2003<p>{t}\u00a0</p>\u00a0</body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
        for name in ("duplicate_metadata", "crawl_pages"):
            want = con.execute(crawl_reports.ORACLE_SQL[name]).fetchall()
            assert sorted(map(tuple, crawl_reports.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want), name
