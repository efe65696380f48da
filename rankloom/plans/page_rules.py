"""Audit rules over page snapshots: every rule with its early exits, guidance, filters and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.structured import missing_properties
from ..operators.samples import with_first
from ..operators.tables import written
from ..sources.views import table
from .crawl_reports import CRAWL, crawl_pages

QUERIES, ORACLE_SQL = {}, {}


def report(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Rule, category, severity, recommendation.
RULES = [
    ("missing_title", "metadata", "high", "fix"), ("title_too_wide", "metadata", "low", "review"), ("title_duplicate", "metadata", "medium", "fix"), ("h1_missing", "headings", "low", "fix"), ("h1_multiple", "headings", "low", "review"),
    ("canonical_invalid", "canonical", "high", "fix"), ("canonical_conflict", "canonical", "high", "fix"), ("canonical_multiple", "canonical", "low", "review"), ("canonical_outside_head", "canonical", "medium", "fix"),
    ("canonical_mismatch", "canonical", "medium", "review"), ("canonical_non_absolute", "canonical", "low", "review"), ("canonical_chain", "canonical", "medium", "fix"), ("connection_error", "response", "high", "fix"),
    ("crawler_access_blocked", "response", "medium", "review"), ("soft_authentication_gate", "response", "medium", "review"), ("client_rendered_content", "response", "medium", "review"), ("near_empty_content", "content", "low", "review"),
    ("soft_404", "response", "high", "fix"), ("client_error", "response", "high", "fix"), ("server_error", "response", "high", "fix"), ("redirected_url", "response", "low", "review"), ("redirect_chain", "response", "medium", "fix"),
    ("slow_response", "response", "low", "review"), ("large_html", "performance", "low", "fix"), ("no_compression", "performance", "low", "fix"), ("http_not_secure", "security", "medium", "fix"), ("mixed_content", "security", "medium", "fix"),
    ("hsts_missing", "security", "low", "review"), ("broken_internal_link", "links", "high", "fix"), ("broken_external_link", "links", "medium", "fix"), ("orphan_page", "links", "low", "review"), ("deep_page", "links", "low", "fix"),
    ("weak_internal_links_to_valuable_page", "links", "low", "fix"), ("missing_meta_description", "metadata", "medium", "fix"), ("meta_description_duplicate", "metadata", "medium", "fix"), ("canonical_missing", "canonical", "low", "review"),
    ("noindex", "indexability", "medium", "review"), ("nofollow", "indexability", "low", "review"), ("x_robots_noindex", "indexability", "medium", "review"), ("robots_blocked", "indexability", "medium", "review"),
    ("canonicalized_page", "indexability", "low", "review"), ("duplicate_content", "content", "medium", "fix"), ("query_coverage_missing", "content", "low", "fix"), ("image_missing_alt", "images", "medium", "fix"),
    ("image_oversized_candidate", "images", "low", "review"), ("viewport_missing", "mobile", "medium", "fix"), ("lang_missing", "international", "low", "fix"), ("hreflang_invalid", "international", "low", "fix"),
    ("hreflang_duplicate", "international", "low", "fix"), ("hreflang_incomplete", "international", "low", "fix"), ("structured_data_missing", "structured-data", "low", "review"), ("jsonld_invalid", "structured-data", "medium", "fix"),
    ("rich_result_required_fields_missing", "structured-data", "medium", "fix"), ("og_title_missing", "social", "low", "review"), ("og_description_missing", "social", "low", "review"), ("og_image_missing", "social", "low", "review"),
    ("twitter_card_missing", "social", "low", "review"),
]
RULES_SQL = "rules(rule, category, severity, kind) AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"
#: Bounds of the rules.
SLOW_MS, LARGE_BYTES, COMPRESSED_FROM, DEEP, WEAK_LINKS, COVERAGE_IMPRESSIONS, LEAST_COVERAGE, EMPTY_WORDS, SHELL_CHARS, RENDERED_CHARS = 2000, 2 * 1024 * 1024, 4096, 4, 1, 50, 0.6, 10, 200, 500
#: Words of a query that a page needn't have.
COVERAGE_STOPWORDS = "a an and are for from how in is of on or the to vs what with".split()
HREFLANG = "^(x-default|[a-z]{2}(-[a-z]{4})?(-[a-z]{2})?)$"

#: What html doesn't say about a crawl, as a fixture: the same text for both engines.
FACTS = {
    "final_url": "CASE WHEN page_id % 71 = 6 THEN concat(url, '&moved=1') ELSE url END",
    "status": "CASE WHEN page_id % 97 = 5 THEN 0 WHEN page_id % 61 = 7 THEN 503 WHEN page_id % 53 = 9 THEN 404 WHEN page_id % 47 = 3 THEN 403 WHEN page_id % 43 = 2 THEN 301 ELSE 200 END",
    "blocked": "page_id % 89 = 4",
    "inlinks": "page_id % 5",
    "response_ms": "(page_id * 37) % 2600",
    "hops": "CASE WHEN page_id % 29 = 1 THEN 2 WHEN page_id % 23 = 1 THEN 1 ELSE 0 END",
    "status_only": "page_id % 67 = 8",
    "rendered": "page_id % 3 = 0",
    "raw_chars": "(page_id * 13) % 400",
    "rendered_chars": "(page_id * 29) % 3000",
    "indexable": "page_id % 31 <> 5",
    "compressed": "page_id % 4 <> 1",
    "hsts": "page_id % 6 <> 1",
    "broken_external": "CASE WHEN page_id % 41 = 11 THEN page_id % 3 ELSE 0 END",
    "depth": "page_id % 7",
    "clicks": "CASE WHEN page_id % 9 = 0 THEN page_id % 4 ELSE 0 END",
    "impressions": "(page_id * 7) % 130",
    "sessions": "(page_id * 3) % 40",
    "robots_allowed": "page_id % 79 <> 12",
    "x_robots": "CASE WHEN page_id % 83 = 13 THEN 'noindex, nofollow' WHEN page_id % 73 = 1 THEN 'nofollow' ELSE '' END",
    "declared_other": "page_id % 2 = 0",
    "oversized": "page_id % 27 = 5",
    "soft_missing": "page_id % 91 = 17",
    "top_query": "CASE WHEN page_id % 5 = 2 THEN lower(concat('how to ', substring(title, 1, 5), ' zzyzx')) ELSE '' END",
    "top_impressions": "(page_id * 11) % 100",
}
#: What the fixture's pages say in their html beside what the test pages hold, as values for SQL; rules read it from the html.
SAID = {
    "login_form": "page_id % 59 = 10",
    "insecure_parts": "CASE WHEN page_id % 37 = 2 THEN 3 ELSE 0 END",
    "meta_robots": "CASE WHEN page_id % 19 = 4 THEN 'NOINDEX,follow' WHEN page_id % 17 = 3 THEN 'nofollow' ELSE '' END",
    "canonical_raw": "CASE page_id % 11 WHEN 0 THEN '' WHEN 1 THEN '/relative/x' WHEN 2 THEN 'http://' WHEN 3 THEN 'https://shop.example/other' ELSE url END",
    "canonical_status": "CASE WHEN page_id % 101 = 3 THEN 'conflicting' WHEN page_id % 101 = 4 THEN 'duplicate' WHEN page_id % 101 = 5 THEN 'outside-head-only' ELSE 'single' END",
    "missing_alt": "CASE WHEN page_id % 8 = 3 THEN 2 ELSE 0 END",
    "hreflang": "CASE page_id % 13 WHEN 1 THEN 'en,de' WHEN 2 THEN 'en,EN' WHEN 3 THEN 'english,x-default' ELSE '' END",
    "hreflang_self": "page_id % 3 = 1",
    "invalid_json_ld": "CASE WHEN page_id % 33 = 1 THEN 1 ELSE 0 END",
    "rich_missing": "page_id % 39 = 2",
    "og_description": "page_id % 10 <> 3",
    "title": "CASE WHEN page_id % 45 = 7 THEN '' ELSE title END",
    "description": "CASE WHEN page_id % 2 = 0 THEN concat('About ', page_id % 50) ELSE '' END",
    "n_h1": "CASE WHEN page_id % 25 = 6 THEN 0 ELSE n_h1 END + CASE WHEN page_id % 21 = 4 THEN 1 ELSE 0 END",
    "lang": "CASE WHEN page_id % 33 = 5 THEN '' ELSE lang END",
    "viewport": "page_id % 3 = 0",
    "og_title": "page_id % 4 = 1",
    "og_image": "page_id % 5 = 2",
    "twitter_card": "page_id % 6 = 3",
    "json_ld": "page_id % 39 = 2 OR page_id % 4 = 0",
}
_HREF = "replace(url, '&', '&amp;')"


def _tag(value: str, before: str, after: str) -> str:
    return f"CASE WHEN {value} <> '' THEN concat('{before}', {value}, '{after}') ELSE '' END"


def _when(condition: str, html: str) -> str:
    return f"CASE WHEN {condition} THEN '{html}' ELSE '' END"


_CANONICAL = f"concat('<link href=\"', {SAID['canonical_raw'].replace('ELSE url', f'ELSE {_HREF}')}, '\" REL=canonical>')"
#: Both as html, in the head and in the body: attributes in any order, with any quotes.
HEAD = ", ".join(
    [
        _tag(f"({SAID['meta_robots']})", '<META content="', '" name=Robots>'), _tag(f"({SAID['description']})", "<meta content=\"", '" name="description"/>'),
        f"CASE WHEN page_id % 101 = 5 OR page_id % 11 = 0 AND page_id % 101 NOT IN (3, 4) THEN '' WHEN page_id % 101 = 3 THEN concat({_CANONICAL}, '<link rel=canonical href=https://shop.example/second>') WHEN page_id % 101 = 4 THEN concat({_CANONICAL}, {_CANONICAL}) ELSE {_CANONICAL} END",
        *(f"CASE WHEN page_id % 13 = {k} THEN concat('<link rel=\"alternate\" hreflang=\"{codes[0]}\" href=\"', CASE WHEN page_id % 3 = 1 THEN concat({_HREF}, '#x') ELSE '/alt' END, '\"><link rel=alternate hreflang={codes[1]} href=/other>') ELSE '' END" for k, codes in ((1, ("en", "de")), (2, ("en", "EN")), (3, ("english", "x-default")))),
        _when(SAID["invalid_json_ld"].split("WHEN ")[1].split(" THEN")[0], '<script type="application/ld+json">{"@type": "Product",</script>'), _when(SAID["rich_missing"], "<script type=application/ld+json>{\"@context\":\"https://schema.org/\",\"@type\":\"Product\",\"name\":\"A\"}</script>"),
        _when("page_id % 4 = 0", '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"O"}</script>'), _when(SAID["og_description"], '<meta property="og:description" content="d">'),
        _when(SAID["viewport"], "<meta name=viewport content=x>"), _when(SAID["og_title"], '<meta content="t" property="og:title">'), _when(SAID["og_image"], '<meta property=og:image content="i">'), _when(SAID["twitter_card"], '<meta name="twitter:card" content="c" />'),
    ]
)
BODY = ", ".join(
    [
        f"CASE WHEN page_id % 101 = 5 THEN {_CANONICAL} ELSE '' END", _when(SAID["login_form"], '<form action="/login/now"><input Type="PASSWORD"></form>'), _when("page_id % 37 = 2", '<img alt="" src="http://a.test/1.png">' * 3),
        _when("page_id % 8 = 3", '<img src="/a.png"><IMG src=/b.png>'), _when("page_id % 21 = 4", "<nav><h1>More</h1></nav>"),
    ]
)
HTML = f"""replace(replace(CASE WHEN page_id % 45 = 7 THEN regexp_replace(h1, '<title>[^<]*</title>', '') ELSE h1 END, '<head>', concat('<head>', {HEAD})), '<body>', concat('<body>', {BODY}))"""
_H1 = """CASE WHEN page_id % 25 = 6 THEN replace(replace(l, '<h1>', '<h2>'), '</h1>', '</h2>') ELSE l END"""
_L = "CASE WHEN page_id % 33 = 5 THEN regexp_replace(html, '<html lang=\"[a-z]*\">', '<html>') ELSE html END"


def fixture_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and html of the test pages with more in their html, so that there is a page for each rule."""
    return pages.withColumn("l", F.expr(_L)).withColumn("h1", F.expr(_H1)).select("page_id", "url", F.expr(HTML).alias("html"))


def _lacks_required(items: Column) -> Column:
    """Whether a JSON-LD item of a type with rich results lacks what these need."""
    lacks = lambda item: F.exists(item["types"], lambda t: F.size(F.coalesce(missing_properties(item["props"], t), F.array())) > 0)
    return F.exists(items, lambda x: (x["format"] == "json-ld") & lacks(x))


def page_snapshots(pages: DataFrame) -> DataFrame:
    """What the html of each page says, read in one pass, with what a crawl observed of it beside the html."""
    c = F.col
    read = crawl_pages(fixture_pages(pages)).withColumns(
        {
            "canonical_raw": c("canonical"), "hreflang": F.array_join(c("alternates")["lang"], ","), "json_ld": F.exists("items", lambda x: x["format"] == "json-ld"), "rich_missing": _lacks_required(c("items")),
            "hreflang_self": F.exists("alternates", lambda x: _same(x["href"], c("url"))),
        }
    )
    return read.drop("alternates", "links", "items").select("*", *[F.expr(sql).alias(name) for name, sql in FACTS.items()])


def findings(pages: DataFrame, start_url: str | None = None, only: set[str] | None = None) -> DataFrame:
    """(page_id, url, rule) for every rule that a page snapshot breaks, or every one of only; no others are looked at.

    Failed requests, blocked ones, errors and redirects end the audit of a page after the rules of their own; pages read for their status
    only, and redirected ones, after those of the response; pages that aren't HTML after those of the transfer. Duplicates are told from
    counts over the audited pages, joined by their keys.
    """
    c, n = F.col, F.lit
    answered = (c("status") > 0) & ~c("blocked")
    ok = answered & c("status").between(200, 299)
    redirected = c("hops") > 0
    page = ok & ~c("status_only") & ~redirected & (c("final_url") == c("url"))
    moved = ok & (redirected | (c("final_url") != c("url")))
    secure = c("final_url").startswith("https://")
    shell = c("rendered") & (c("raw_chars") < SHELL_CHARS) & (c("rendered_chars") >= RENDERED_CHARS) & (c("rendered_chars") >= c("raw_chars") * 3)
    absolute = c("canonical_raw").rlike("^https?://[^/]+")
    relative = c("canonical_raw").startswith("/")
    resolved = F.when(absolute, c("canonical_raw")).when(relative, F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), c("canonical_raw")))
    named = ~c("canonical_status").isin("conflicting", "outside-head-only")
    robots = lambda column, word: F.array_contains(F.transform(F.split(F.lower(column), ","), lambda x: F.trim(x)), word)
    codes = F.transform(F.split(F.lower("hreflang"), ","), lambda x: F.trim(x))
    has_codes = c("hreflang") != ""
    terms = F.array_distinct(F.filter(F.split(F.lower("top_query"), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(COVERAGE_STOPWORDS)))
    shown = F.lower(F.concat_ws(" ", "title", "description", "text"))
    share = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: shown.contains(t))) / F.size(terms))
    other = (c("target") != "") & ~_same(c("target"), c("final_url"))
    valuable = (c("clicks") > 0) | (c("impressions") >= 100) | (c("sessions") >= 25)
    linked = c("inlinks") > 0

    checks: dict[str, Column] = {
        "connection_error": c("status") == 0,
        "crawler_access_blocked": (c("status") > 0) & c("blocked"),
        "server_error": answered & (c("status") >= 500),
        "client_error": answered & c("status").between(400, 499),
        "broken_internal_link": answered & linked & ((c("status") >= 500) | c("status").isin(404, 410)),
        "redirected_url": (answered & c("status").between(300, 399)) | moved,
        "redirect_chain": ok & (c("hops") > 1),
        "slow_response": ok & (c("response_ms") > SLOW_MS),
        "soft_authentication_gate": page & c("login_form"),
        "soft_404": page & c("soft_missing"),
        "client_rendered_content": page & shell,
        "near_empty_content": page & ~shell & c("indexable") & (c("n_words") < EMPTY_WORDS),
        "large_html": page & (c("html_bytes") > LARGE_BYTES),
        "no_compression": page & ~c("compressed") & (c("html_bytes") > COMPRESSED_FROM),
        "http_not_secure": page & ~secure,
        "mixed_content": page & secure & (c("insecure_parts") > 0),
        "hsts_missing": page & secure & ~c("hsts"),
        "broken_external_link": page & (c("broken_external") > 0),
        "orphan_page": page & c("indexable") & ~linked & ~(c("url").eqNullSafe(n(start_url))),
        "deep_page": page & (c("depth") > DEEP),
        "weak_internal_links_to_valuable_page": page & c("indexable") & valuable & (c("inlinks") <= WEAK_LINKS),
        "robots_blocked": page & ~c("robots_allowed"),
        "x_robots_noindex": page & robots("x_robots", "noindex"),
        "nofollow": page & (robots("x_robots", "nofollow") | robots("meta_robots", "nofollow")),
        "missing_title": page & (c("title") == ""),
        "title_too_wide": page & (T.title_pixels(c("title")) > T.TITLE_PIXELS),
        "title_duplicate": page & (c("same_titles") > 1),
        "missing_meta_description": page & (c("description") == ""),
        "meta_description_duplicate": page & (c("same_descriptions") > 1),
        "h1_missing": page & (c("n_h1") == 0),
        "h1_multiple": page & (c("n_h1") > 1),
        "canonical_conflict": page & (c("canonical_status") == "conflicting"),
        "canonical_multiple": page & (c("canonical_status") == "duplicate"),
        "canonical_outside_head": page & (c("canonical_status") == "outside-head-only"),
        "canonical_invalid": page & named & (c("target") == "") & (c("canonical_raw") != ""),
        "canonical_missing": page & named & (c("target") == "") & (c("canonical_raw") == ""),
        "canonical_non_absolute": page & (~named | (c("target") != "")) & (c("canonical_raw") != "") & ~absolute,
        "canonical_chain": page & (c("target") != "") & (c("next_target") != "") & ~_same(c("next_target"), c("target")),
        "noindex": page & robots("meta_robots", "noindex"),
        "canonicalized_page": page & other & c("declared_other"),
        "canonical_mismatch": page & other & ~c("declared_other"),
        "duplicate_content": page & (c("same_contents") > 1),
        "query_coverage_missing": page & (c("top_query") != "") & (c("top_impressions") >= COVERAGE_IMPRESSIONS) & (c("covered") < LEAST_COVERAGE),
        "image_missing_alt": page & (c("missing_alt") > 0),
        "image_oversized_candidate": page & c("oversized"),
        "viewport_missing": page & ~c("viewport"),
        "lang_missing": page & (c("lang") == ""),
        "hreflang_invalid": page & has_codes & F.exists(codes, lambda x: ~x.rlike(HREFLANG)),
        "hreflang_duplicate": page & has_codes & (F.size(F.array_distinct(codes)) < F.size(codes)),
        "hreflang_incomplete": page & has_codes & ~c("hreflang_self"),
        "structured_data_missing": page & c("indexable") & ~c("json_ld") & (c("invalid_json_ld") == 0),
        "jsonld_invalid": page & (c("invalid_json_ld") > 0),
        "rich_result_required_fields_missing": page & c("rich_missing"),
        "og_title_missing": page & ~c("og_title"),
        "og_description_missing": page & ~c("og_description"),
        "og_image_missing": page & ~c("og_image"),
        "twitter_card_missing": page & ~c("twitter_card"),
    }
    tidy = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    known = pages.withColumn("target", F.coalesce(resolved, n(""))).withColumns({"title_key": tidy("title"), "description_key": tidy("description"), "covered": share}).drop("text")
    known = written(known, "snapshots")  # narrow: html and text are read once
    audited = known.filter(c("status").between(200, 299))
    for key, name, counts in (("title_key", "same_titles", c("title_key") != ""), ("description_key", "same_descriptions", c("description_key") != ""), ("content_hash", "same_contents", c("n_words") >= 20)):
        same = audited.filter(counts).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name)).filter(c(name) > 1)
        # the size of a group decides only for members that count themselves
        known = known.join(same, (c(key) == c("_key")) & counts, "left").drop("_key")
    targets = audited.filter("target <> ''").groupBy(_key(c("final_url")).alias("_key")).agg(F.max("target").alias("next_target"))
    known = known.join(targets, _key(c("target")) == c("_key"), "left").drop("_key")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, n(False)), n(rule)) for rule, cond in checks.items() if only is None or rule in only]))
    return known.select("page_id", "url", F.explode(broken).alias("rule"))


def _key(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _same(a: Column, b: Column) -> Column:
    return _key(a) == _key(b)


def _advance_sql(title: str) -> str:
    """The pixel width in SQL, one character at a time."""
    widths = ", ".join(f"({chr(39) + chr(39) + chr(39) + chr(39) if ch == chr(39) else chr(39) + ch + chr(39)}, {w})" for w, chars in T.ADVANCES.items() for ch in chars)
    kerning = " + ".join(f"({w}) * (length(t) - length(replace(t, '{p}', ''))) / 2" for p, w in T.KERNING.items())
    return f"""widths(ch, w) AS (VALUES {widths}),
titles AS (SELECT DISTINCT title, strip_accents(replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), 'ß', 'ß')) AS t FROM {title}),
glyphs AS (SELECT title, unnest(string_split(t, '')) AS ch FROM titles WHERE t <> ''),
advances AS (SELECT title, sum(coalesce(w, {T.OTHER})) AS w FROM glyphs LEFT JOIN widths USING (ch) GROUP BY 1),
pixels AS (SELECT t.title, floor((coalesce(a.w, 0) + {kerning}) * 10 + 0.5 + 1e-9) / 10 AS pixels FROM titles t LEFT JOIN advances a USING (title))"""


_SIZED = f"sized AS (SELECT page_id, strlen({HTML}) AS html_bytes FROM (SELECT *, {_H1} AS h1 FROM (SELECT *, {_L} AS l FROM pages)))"
_SNAPSHOTS = (
    CRAWL
    + f""", {_SIZED}, said AS (SELECT p.* EXCLUDE (html_bytes, canonical, """
    + ", ".join(k for k in SAID if k in ("title", "description", "n_h1", "lang", "viewport", "og_title", "og_image", "twitter_card", "json_ld"))
    + "), sized.html_bytes, "
    + ", ".join(f"{sql} AS {name}" for name, sql in SAID.items())
    + " FROM pages_c p JOIN sized USING (page_id)), snap AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in FACTS.items())
    + " FROM said), "
    + _advance_sql("snap")
)

_STOP = "[" + ", ".join(f"'{w}'" for w in COVERAGE_STOPWORDS) + "]"
_FINDINGS = (
    _SNAPSHOTS
    + r""",
k0 AS (SELECT *, CASE WHEN regexp_matches(canonical_raw, '^https?://[^/]+') THEN canonical_raw WHEN starts_with(canonical_raw, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), canonical_raw) ELSE '' END AS target,
  lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS tk, lower(trim(regexp_replace(description, '\s+', ' ', 'g'))) AS dk, status BETWEEN 200 AND 299 AS audited FROM snap),
k1 AS (SELECT *, tk <> '' AND count(*) FILTER (WHERE audited) OVER (PARTITION BY tk) > 1 AS same_title, dk <> '' AND count(*) FILTER (WHERE audited) OVER (PARTITION BY dk) > 1 AS same_desc,
  n_words >= 20 AND count(*) FILTER (WHERE audited AND n_words >= 20) OVER (PARTITION BY content_hash) > 1 AS same_content FROM k0),
nexts AS (SELECT regexp_replace(final_url, '#.*$', '') AS key, max(target) AS next_target FROM k0 WHERE audited AND target <> '' GROUP BY 1),
k2 AS (SELECT k1.*, next_target, pixels, status > 0 AND NOT blocked AS answered, status > 0 AND NOT blocked AND audited AS ok FROM k1 LEFT JOIN nexts ON nexts.key = regexp_replace(k1.target, '#.*$', '') LEFT JOIN pixels USING (title)),
k3 AS (SELECT *, ok AND NOT status_only AND hops = 0 AND final_url = url AS page, starts_with(final_url, 'https://') AS secure, canonical_status NOT IN ('conflicting', 'outside-head-only') AS named,
  rendered AND raw_chars < 200 AND rendered_chars >= 500 AND rendered_chars >= raw_chars * 3 AS shell, regexp_matches(canonical_raw, '^https?://[^/]+') AS absolute,
  list_transform(string_split(lower(hreflang), ','), lambda x: trim(x)) AS codes, list_transform(string_split(lower(x_robots), ','), lambda x: trim(x)) AS xr, list_transform(string_split(lower(meta_robots), ','), lambda x: trim(x)) AS mr,
  list_distinct(list_filter(regexp_split_to_array(lower(top_query), '[^a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(STOPWORDS, t))) AS terms, lower(concat_ws(' ', title, description, text)) AS shown,
  target <> '' AND regexp_replace(target, '#.*$', '') <> regexp_replace(final_url, '#.*$', '') AS other FROM k2),
found AS (SELECT page_id, url, unnest(list_filter([
  CASE WHEN status = 0 THEN 'connection_error' END, CASE WHEN status > 0 AND blocked THEN 'crawler_access_blocked' END, CASE WHEN answered AND status >= 500 THEN 'server_error' END, CASE WHEN answered AND status BETWEEN 400 AND 499 THEN 'client_error' END,
  CASE WHEN answered AND inlinks > 0 AND (status >= 500 OR status IN (404, 410)) THEN 'broken_internal_link' END, CASE WHEN answered AND (status BETWEEN 300 AND 399 OR (audited AND (hops > 0 OR final_url <> url))) THEN 'redirected_url' END,
  CASE WHEN ok AND hops > 1 THEN 'redirect_chain' END, CASE WHEN ok AND response_ms > 2000 THEN 'slow_response' END, CASE WHEN page AND login_form THEN 'soft_authentication_gate' END, CASE WHEN page AND soft_missing THEN 'soft_404' END,
  CASE WHEN page AND shell THEN 'client_rendered_content' END, CASE WHEN page AND NOT shell AND indexable AND n_words < 10 THEN 'near_empty_content' END, CASE WHEN page AND html_bytes > 2097152 THEN 'large_html' END,
  CASE WHEN page AND NOT compressed AND html_bytes > 4096 THEN 'no_compression' END, CASE WHEN page AND NOT secure THEN 'http_not_secure' END, CASE WHEN page AND secure AND insecure_parts > 0 THEN 'mixed_content' END,
  CASE WHEN page AND secure AND NOT hsts THEN 'hsts_missing' END, CASE WHEN page AND broken_external > 0 THEN 'broken_external_link' END, CASE WHEN page AND indexable AND inlinks = 0 THEN 'orphan_page' END, CASE WHEN page AND depth > 4 THEN 'deep_page' END,
  CASE WHEN page AND indexable AND (clicks > 0 OR impressions >= 100 OR sessions >= 25) AND inlinks <= 1 THEN 'weak_internal_links_to_valuable_page' END, CASE WHEN page AND NOT robots_allowed THEN 'robots_blocked' END,
  CASE WHEN page AND list_contains(xr, 'noindex') THEN 'x_robots_noindex' END, CASE WHEN page AND (list_contains(xr, 'nofollow') OR list_contains(mr, 'nofollow')) THEN 'nofollow' END, CASE WHEN page AND title = '' THEN 'missing_title' END,
  CASE WHEN page AND pixels > 580 THEN 'title_too_wide' END, CASE WHEN page AND same_title THEN 'title_duplicate' END, CASE WHEN page AND description = '' THEN 'missing_meta_description' END, CASE WHEN page AND same_desc THEN 'meta_description_duplicate' END,
  CASE WHEN page AND n_h1 = 0 THEN 'h1_missing' END, CASE WHEN page AND n_h1 > 1 THEN 'h1_multiple' END, CASE WHEN page AND canonical_status = 'conflicting' THEN 'canonical_conflict' END, CASE WHEN page AND canonical_status = 'duplicate' THEN 'canonical_multiple' END,
  CASE WHEN page AND canonical_status = 'outside-head-only' THEN 'canonical_outside_head' END, CASE WHEN page AND named AND target = '' AND canonical_raw <> '' THEN 'canonical_invalid' END, CASE WHEN page AND named AND canonical_raw = '' THEN 'canonical_missing' END,
  CASE WHEN page AND (NOT named OR target <> '') AND canonical_raw <> '' AND NOT absolute THEN 'canonical_non_absolute' END, CASE WHEN page AND target <> '' AND next_target <> '' AND regexp_replace(next_target, '#.*$', '') <> regexp_replace(target, '#.*$', '') THEN 'canonical_chain' END,
  CASE WHEN page AND list_contains(mr, 'noindex') THEN 'noindex' END, CASE WHEN page AND other AND declared_other THEN 'canonicalized_page' END, CASE WHEN page AND other AND NOT declared_other THEN 'canonical_mismatch' END,
  CASE WHEN page AND same_content THEN 'duplicate_content' END, CASE WHEN page AND top_query <> '' AND top_impressions >= 50 AND len(terms) > 0 AND len(list_filter(terms, lambda t: contains(shown, t)))::DOUBLE / len(terms) < 0.6 THEN 'query_coverage_missing' END,
  CASE WHEN page AND missing_alt > 0 THEN 'image_missing_alt' END, CASE WHEN page AND oversized THEN 'image_oversized_candidate' END, CASE WHEN page AND NOT viewport THEN 'viewport_missing' END, CASE WHEN page AND lang = '' THEN 'lang_missing' END,
  CASE WHEN page AND hreflang <> '' AND len(list_filter(codes, lambda x: NOT regexp_matches(x, '^(x-default|[a-z]{2}(-[a-z]{4})?(-[a-z]{2})?)$'))) > 0 THEN 'hreflang_invalid' END,
  CASE WHEN page AND hreflang <> '' AND len(list_distinct(codes)) < len(codes) THEN 'hreflang_duplicate' END, CASE WHEN page AND hreflang <> '' AND NOT hreflang_self THEN 'hreflang_incomplete' END,
  CASE WHEN page AND indexable AND NOT json_ld AND invalid_json_ld = 0 THEN 'structured_data_missing' END, CASE WHEN page AND invalid_json_ld > 0 THEN 'jsonld_invalid' END, CASE WHEN page AND rich_missing THEN 'rich_result_required_fields_missing' END,
  CASE WHEN page AND NOT og_title THEN 'og_title_missing' END, CASE WHEN page AND NOT og_description THEN 'og_description_missing' END, CASE WHEN page AND NOT og_image THEN 'og_image_missing' END, CASE WHEN page AND NOT twitter_card THEN 'twitter_card_missing' END
  ], lambda x: x IS NOT NULL)) AS rule FROM k3)""".replace("STOPWORDS", _STOP)
)


def found(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    return findings(page_snapshots(table(spark, sf_dir, "pages")), only=only)


@report("page_rule_findings", f"WITH {_FINDINGS} SELECT page_id, rule FROM found")
def page_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that every page breaks, with the early exits of failed, blocked, redirected and partly read pages."""
    return found(spark, sf_dir).select("page_id", "rule")


_RULE = "rule string, category string, severity string, kind string"
_SEVERITY = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


#: Rules that ask for a fix; the others ask for a review.
FIXES = {rule for rule, _, _, kind in RULES if kind == "fix"}


def ruled(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> DataFrame:
    """Findings with what their rules say."""
    return found(spark, sf_dir, only).join(F.broadcast(spark.createDataFrame(RULES, _RULE)), "rule")  # the table above


@report("audit_issues", f"WITH {_FINDINGS}, {RULES_SQL} SELECT page_id, rule, category, severity, kind FROM found JOIN rules USING (rule)")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).drop("url")


@report("issue_groups", f"WITH {_FINDINGS}, {RULES_SQL} SELECT rule, category, severity, kind, count(*) AS n, list_sort(list(DISTINCT url))[1:10] AS samples FROM found JOIN rules USING (rule) GROUP BY 1, 2, 3, 4")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(ruled(spark, sf_dir), "findings")
    return with_first(rows.groupBy("rule", "category", "severity", "kind").agg(F.count("*").alias("n")), rows, ["rule"], "url", 10, "samples")


@report("affected_urls", f"WITH {_FINDINGS}, {RULES_SQL} SELECT url, page_id, rule, severity FROM found JOIN rules USING (rule) WHERE kind = 'fix' ORDER BY {_SEVERITY} DESC, url, page_id, rule LIMIT 100")
def affected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ruled(spark, sf_dir, FIXES).select("url", "page_id", "rule", "severity")
    return rows.orderBy(F.desc(F.expr(_SEVERITY)), "url", "page_id", "rule").limit(100)


@report(
    "top_fixes",
    f"""WITH {_FINDINGS}, {RULES_SQL}, g AS (SELECT rule, severity, count(*) AS n FROM found JOIN rules USING (rule) WHERE kind = 'fix' GROUP BY 1, 2)
    SELECT rule, severity, n, 1000 * {_SEVERITY} + n * 5 AS score FROM g ORDER BY score DESC, severity, n DESC, rule LIMIT 10""",
)
def top_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules to fix first, by severity and reach."""
    g = ruled(spark, sf_dir, FIXES).groupBy("rule", "severity").agg(F.count("*").alias("n"))
    return g.withColumn("score", 1000 * F.expr(_SEVERITY) + F.col("n") * 5).orderBy(F.desc("score"), "severity", F.desc("n"), "rule").limit(10)


@report("rule_guidance", f"WITH {_FINDINGS}, {RULES_SQL} SELECT r.rule, category, severity, kind, count(f.page_id) AS n_pages FROM rules r LEFT JOIN found f ON f.rule = r.rule GROUP BY 1, 2, 3, 4")
def rule_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, those that no page breaks too, with what they say and how many pages they concern."""
    counts = found(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n_pages"))
    rules = spark.createDataFrame(RULES, "rule string, category string, severity string, kind string")
    return rules.join(counts, "rule", "left").fillna(0, ["n_pages"])


def url_like(url: Column, pattern: str) -> Column:
    """Whether the parts of the pattern between its stars occur in the url in this order, anywhere in it."""
    parts = [p for p in pattern.split("*") if p]
    escaped = [p.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") for p in parts]
    return url.like("%" + "%".join(escaped) + "%") if parts else F.lit(True)


@report("filtered_findings", f"WITH {_FINDINGS}, {RULES_SQL} SELECT page_id, rule, severity FROM found JOIN rules USING (rule) WHERE category IN ('canonical', 'metadata') AND severity IN ('high', 'medium') AND regexp_matches(url, 'example\\.com.*/en/')")
def filtered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by category, severity and a pattern of the url."""
    rules = spark.createDataFrame([r for r in RULES if r[1] in ("canonical", "metadata") and r[2] in ("high", "medium")], "rule string, category string, severity string, kind string")
    return found(spark, sf_dir).filter(url_like(F.col("url"), "example.com*/en/")).join(F.broadcast(rules), "rule").select("page_id", "rule", "severity")  # the table above


@report("title_widths", f"WITH {_SNAPSHOTS} SELECT page_id, pixels, CASE WHEN pixels > 580 THEN 'over-reference' WHEN pixels >= 550 THEN 'near-reference' ELSE 'within-reference' END AS status FROM snap JOIN pixels USING (title)")
def title_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_snapshots(table(spark, sf_dir, "pages")).select("page_id", T.title_pixels(F.col("title")).alias("pixels"))
    return pages.select("page_id", "pixels", T.title_status(F.col("pixels")).alias("status"))


@report(
    "fix_queue",
    f"""WITH {_FINDINGS}, {RULES_SQL}, g AS (SELECT rule, severity, count(*) AS n, count(DISTINCT url) AS n_urls FROM found JOIN rules USING (rule) WHERE kind = 'fix' GROUP BY 1, 2),
    s AS (SELECT rule, severity, n, n_urls, CASE severity WHEN 'high' THEN 80 WHEN 'medium' THEN 55 ELSE 30 END + least(20, n_urls) AS impact FROM g)
    SELECT rule, severity, n_urls, impact, floor((impact * 0.6 + 90 * 0.25 + 70 * 0.15) + 0.5)::BIGINT AS priority FROM s""",
)
def fix_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules to fix as items of a work queue: impact by severity and reach, then a priority with fixed confidence and ease."""
    rules = spark.createDataFrame(RULES, "rule string, category string, severity string, kind string").filter("kind = 'fix'")
    g = found(spark, sf_dir).join(F.broadcast(rules), "rule").groupBy("rule", "severity").agg(F.countDistinct("url").alias("n_urls"))
    impact = F.expr("CASE severity WHEN 'high' THEN 80 WHEN 'medium' THEN 55 ELSE 30 END") + F.least(F.lit(20), F.col("n_urls"))
    return g.withColumn("impact", impact).withColumn("priority", F.floor(F.col("impact") * 0.6 + 90 * 0.25 + 70 * 0.15 + 0.5))


@report("access_blocks", f"WITH {_SNAPSHOTS}, b AS (SELECT url, page_id % 3 AS provider FROM snap WHERE blocked) SELECT provider, count(*) AS n, list_sort(list(DISTINCT url))[1:10] AS samples FROM b GROUP BY 1")
def access_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked requests by provider, with the first ten urls of each."""
    rows = table(spark, sf_dir, "pages").filter(F.expr(FACTS["blocked"])).select("url", (F.col("page_id") % 3).alias("provider"))
    return with_first(rows.groupBy("provider").agg(F.count("*").alias("n")), rows, ["provider"], "url", 10, "samples")


@report("first_snapshots", "SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def first_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot of each url, and how many there are."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@report(
    "geo_gaps",
    f"""WITH {_FINDINGS}, v AS (SELECT page_id, url, page FROM k3 WHERE page AND indexable AND (clicks > 0 OR impressions >= 100 OR sessions >= 25)),
    gap(rule, gap) AS (VALUES ('structured_data_missing', 'structured-data'), ('jsonld_invalid', 'structured-data'), ('robots_blocked', 'access'), ('noindex', 'access'), ('query_coverage_missing', 'answers'), ('missing_meta_description', 'answers'), ('orphan_page', 'discovery'), ('weak_internal_links_to_valuable_page', 'discovery'))
    SELECT v.page_id, list_sort(list(DISTINCT gap)) AS gaps, count(DISTINCT gap) AS n_gaps FROM v JOIN found f ON f.page_id = v.page_id JOIN gap ON gap.rule = f.rule GROUP BY 1""",
)
def geo_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps valuable pages out of generated answers: kinds of gaps from the rules that they break."""
    snapshots = written(page_snapshots(table(spark, sf_dir, "pages")), "pages")
    valuable = snapshots.filter((F.col("clicks") > 0) | (F.col("impressions") >= 100) | (F.col("sessions") >= 25)).filter("indexable").select("page_id")
    rows = findings(snapshots)
    gap = F.when(F.col("rule").isin("structured_data_missing", "jsonld_invalid"), "structured-data").when(F.col("rule").isin("robots_blocked", "noindex"), "access")
    gap = gap.when(F.col("rule").isin("query_coverage_missing", "missing_meta_description"), "answers").when(F.col("rule").isin("orphan_page", "weak_internal_links_to_valuable_page"), "discovery")
    named = rows.select("page_id", gap.alias("gap")).filter("gap is not null").join(valuable, "page_id")
    return named.groupBy("page_id").agg(F.array_sort(F.collect_set("gap")).alias("gaps")).withColumn("n_gaps", F.size("gaps").cast("long"))  # four kinds at most


#: What agents need of a site, by the rules that stand against it.
AGENT_CHECKS = {
    "reachable": ["connection_error", "server_error", "client_error"], "no-login": ["soft_authentication_gate"], "html-content": ["client_rendered_content", "near_empty_content"], "fast": ["slow_response"],
    "crawlable": ["robots_blocked", "x_robots_noindex", "noindex"], "described": ["missing_title", "missing_meta_description"], "structured": ["structured_data_missing", "jsonld_invalid"], "canonical": ["canonical_invalid", "canonical_conflict"],
}
_CHECKS_SQL = "checks(name, rule) AS (VALUES " + ", ".join(f"('{name}', '{rule}')" for name, rules in AGENT_CHECKS.items() for rule in rules) + ")"


@report(
    "agent_readiness",
    f"""WITH {_FINDINGS}, {_CHECKS_SQL}, t AS (SELECT count(*) AS n FROM pages), f AS (SELECT name, count(DISTINCT page_id) AS failing FROM checks LEFT JOIN found USING (rule) GROUP BY 1)
    SELECT name, failing, n - failing AS passing, floor((n - failing) * 1000.0 / n + 0.5) / 10 AS share, CASE WHEN failing = 0 THEN 'pass' WHEN failing * 10 < n THEN 'warn' ELSE 'fail' END AS status FROM f, t""",
)
def agent_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each thing that agents need, how many pages stand for and against it."""
    checks = spark.createDataFrame([(name, rule) for name, rules in AGENT_CHECKS.items() for rule in rules], "name string, rule string")
    failing = found(spark, sf_dir, {rule for rules in AGENT_CHECKS.values() for rule in rules}).join(F.broadcast(checks), "rule").groupBy("name").agg(F.countDistinct("page_id").alias("failing"))  # the table above
    n = table(spark, sf_dir, "pages").count()
    named = checks.select("name").distinct().join(failing, "name", "left").fillna(0, ["failing"]).withColumn("passing", F.lit(n) - F.col("failing"))
    status = F.when(F.col("failing") == 0, "pass").when(F.col("failing") * 10 < n, "warn").otherwise("fail")
    return named.select("name", "failing", "passing", (F.floor(F.col("passing") * 1000.0 / n + 0.5) / 10).alias("share"), status.alias("status"))


#: Checks of the scorecard with their weights, and the share of pages at which they pass.
SCORECARD = [("ai-bot-access", 20, 1.0), ("https", 10, 1.0), ("indexable-pages", 15, 0.85), ("structured-data", 15, 0.5), ("valid-json-ld", 10, 1.0), ("entity-identity", 20, 0.9), ("answerable-content", 10, 0.5)]
_SCORES = (
    _SNAPSHOTS
    + """, r AS (SELECT avg(robots_allowed::INT) AS r0, avg(starts_with(url, 'https://')::INT) AS r1, avg(indexable::INT) AS r2, avg(json_ld::INT) AS r3, avg((invalid_json_ld = 0)::INT) FILTER (WHERE json_ld OR invalid_json_ld > 0) AS r4, avg((NOT rich_missing)::INT) AS r5,
    avg((n_h1 = 1 AND n_words >= 60)::INT) FILTER (WHERE indexable) AS r6, bool_or(status_only) AS partial FROM snap),
c AS (SELECT unnest(["""
    + ", ".join(f"'{n}'" for n, _, _ in SCORECARD)
    + "]) AS name, unnest(["
    + ", ".join(str(w) for _, w, _ in SCORECARD)
    + "]) AS weight, unnest(["
    + ", ".join(str(at) for _, _, at in SCORECARD)
    + """]::DOUBLE[]) AS pass_at, unnest([r0, r1, r2, r3, r4, r5, r6]) AS ratio, partial FROM r),
k AS (SELECT *, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio >= pass_at THEN 'pass' WHEN ratio > 0 THEN 'warn' ELSE 'fail' END AS status FROM c)"""
)


def scorecard_checks(snapshots: DataFrame) -> DataFrame:
    """name, weight, ratio, status, partial: a row for each check. Checks of no pages are unknown."""
    c = F.col
    share = lambda cond, among=F.lit(True): F.avg(F.when(among, cond.cast("int")))
    ratios = [
        share(c("robots_allowed")), share(c("url").startswith("https://")), share(c("indexable")), share(c("json_ld")), share(c("invalid_json_ld") == 0, c("json_ld") | (c("invalid_json_ld") > 0)), share(~c("rich_missing")),
        share((c("n_h1") == 1) & (c("n_words") >= 60), c("indexable")),
    ]
    wide = snapshots.agg(*[r.alias(f"r{i}") for i, r in enumerate(ratios)], F.max("status_only").alias("partial"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(at).alias("pass_at"), c(f"r{i}").alias("ratio")) for i, (n, w, at) in enumerate(SCORECARD)])
    each = wide.select(F.explode(rows).alias("k"), "partial").select("k.*", "partial")
    status = F.when(c("ratio").isNull(), "unknown").when(c("ratio") >= c("pass_at"), "pass").when(c("ratio") > 0, "warn").otherwise("fail")
    return each.select("name", "weight", "ratio", status.alias("status"), "partial")


@report("scorecard_checks", f"WITH {_SCORES} SELECT name, weight, ratio, status FROM k")
def scorecard_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard_checks(page_snapshots(table(spark, sf_dir, "pages"))).drop("partial")


@report(
    "ai_search_scorecard",
    f"""WITH {_SCORES}, s AS (SELECT floor(100 * sum(weight * CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END) FILTER (WHERE status <> 'unknown') / sum(weight) FILTER (WHERE status <> 'unknown') + 0.5) AS score, bool_or(partial) AS partial FROM k)
    SELECT CASE WHEN partial THEN least(score, 99) ELSE score END::BIGINT AS score, partial FROM s""",
)
def ai_search_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted checks: full credit at their share, half for any; unknown ones don't count; a partial crawl stays below 100."""
    known = scorecard_checks(page_snapshots(table(spark, sf_dir, "pages"))).filter("status <> 'unknown'")
    credit = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    s = known.agg(F.floor(100 * F.sum(F.col("weight") * credit) / F.sum("weight") + 0.5).alias("score"), F.max("partial").alias("partial"))
    return s.select(F.when(F.col("partial"), F.least("score", F.lit(99))).otherwise(F.col("score")).alias("score"), "partial")
