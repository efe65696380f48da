"""What a page says, read once from its HTML: a stream of tokens and a stack of open elements, a page at a time inside the tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}
#: Elements without an end tag, and those whose start ends another one of their group.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
GROUPS = {t: g for g in (("p",), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}
HIDDEN = {"script", "style", "nav", "footer", "title"}
#: Attributes that hold an element's value as microdata; others have their text.
VALUES = {"meta": "content", "a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value", "time": "datetime", **dict.fromkeys("audio embed iframe img source track video".split(), "src")}
#: Fixed value: prefixes that need no declaration.
SCHEMA = re.compile(r"(?i)^https?://(?:www\.)?schema\.org/+([A-Za-z][A-Za-z0-9]*)$")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Reading(NamedTuple):
    """How the entities and the white space of texts and titles are read; those of attributes are always read as HTML says."""

    decode: Callable[[str], str] = unescape
    decode_title: Callable[[str], str] = unescape
    clean: Callable[[str], str] = _clean
    clean_title: Callable[[str], str] = _clean


STANDARD = Reading()


def tokens(html: str, reading: Reading = STANDARD) -> Iterator[tuple[str, str, dict]]:
    """("start", name, attributes), ("end", name, {}) and ("text", text, {}); names in lower case, entities decoded outside scripts and
    styles, the first of repeated attributes. A tag that never ends drops the rest, as browsers do."""
    at = 0
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            begin = len(html)
        if begin > at:
            yield "text", reading.decode(html[at:begin]), {}
        if begin == len(html):
            return
        m = _TOKEN.match(html, begin)
        if m is None:
            if begin + 1 < len(html) and html[begin + 1].isascii() and html[begin + 1].isalpha():
                return
            yield "text", "<", {}
            at = begin + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, {}
            continue
        attributes: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""))
        yield "start", name, attributes
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            stop = end.start() if end else len(html)
            if stop > at:
                decode = reading.decode_title if name == "title" else reading.decode
                yield "text", html[at:stop] if name in ("script", "style") else decode(html[at:stop]), {}
            at = stop


def schema_types(values: str, vocab: str | None = None, prefixes: dict[str, str] | None = None) -> list[str]:
    """Names of schema.org types, given as addresses, under a vocabulary or behind a prefix; others are left out."""
    out = []
    for v in values.split():
        before, colon, after = v.partition(":")
        for iri in (v, f"{(prefixes or {}).get(before, '')}{after}" if colon else f"{vocab.rstrip('/')}/{v}" if vocab else ""):
            if m := SCHEMA.match(iri):
                out.append(m[1])
                break
    return list(dict.fromkeys(out))


class _Item(dict):
    """format, path, types, id, props (name to text, the first of each) and same_as."""

    def __init__(self, form: str, path: str, types: list[str], id_: str | None) -> None:
        super().__init__(format=form, path=path, types=types, id=id_, props={}, same_as=[])

    def put(self, name: str, value: str) -> None:
        if value.strip():
            self["props"].setdefault(name, value)
            if name == "sameAs":
                self["same_as"].append(value.strip())


def json_items(block: str) -> list[_Item] | None:
    """Typed nodes of a JSON-LD block, at any depth, with their paths; null if it isn't JSON."""
    try:
        root = json.loads(block)
    except (ValueError, RecursionError):
        return None
    out, todo = [], [(root, "$", None, {})]
    while todo:
        node, path, vocab, prefixes = todo.pop()
        if isinstance(node, list):
            todo += [(x, f"{path}[{i}]", vocab, prefixes) for i, x in reversed(list(enumerate(node)))]
        if not isinstance(node, dict):
            continue
        for context in (c if isinstance(c := node.get("@context"), list) else [c]):
            if isinstance(context, str):
                vocab = context if SCHEMA.match(f"{context.rstrip('/')}/Thing") else vocab
            elif isinstance(context, dict):
                named = {k: v.get("@id") if isinstance(v, dict) else v for k, v in context.items()}
                vocab = named["@vocab"] if isinstance(named.get("@vocab"), str) else vocab
                prefixes = prefixes | {k: v for k, v in named.items() if isinstance(v, str) and k != "@vocab"}
        given = node.get("@type")
        types = schema_types(" ".join(t for t in (given if isinstance(given, list) else [given]) if isinstance(t, str)), vocab, prefixes)
        if types:
            item = _Item("json-ld", path, types, node["@id"] if isinstance(node.get("@id"), str) else None)
            for k, v in node.items():
                if k[:1] != "@" and v not in (None, "", [], {}):
                    for x in v if isinstance(v, list) and k == "sameAs" else [v]:
                        item.put(k, x if isinstance(x, str) else json.dumps(x))
            out.append(item)
        todo += [(v, f"{path}.{k}", vocab, prefixes) for k, v in reversed(list(node.items())) if k != "@context"]
    return out


class _Scopes:
    """Open elements with the item that they belong to, for microdata and RDFa side by side."""

    def __init__(self) -> None:
        self.open: list[dict] = [{"name": "", "microdata": None, "rdfa": None, "vocab": None, "prefixes": {}, "takes": []}]
        self.items: list[_Item] = []
        self.counts: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.taking: list[list[str]] = []

    def _item(self, form: str, top: dict, names: list[str], types: list[str], id_: str | None) -> _Item:
        parent = top[form]
        stem = f"{parent['path']}.{names[0]}" if parent is not None and names else f"${form}"
        n = self.counts[stem] = self.counts.get(stem, -1) + 1
        item = _Item(form, f"{stem}[{n}]", types, id_)
        if parent is not None:
            for p in names:
                parent["props"].setdefault(p, item["path"])
        self.items.append(item)
        return item

    def start(self, name: str, a: dict[str, str]) -> None:
        while len(self.open) > 1 and self.open[-1]["name"] in GROUPS.get(name, ()):
            self.close()
        top = self.open[-1]
        now = {"name": name, "microdata": top["microdata"], "rdfa": top["rdfa"], "vocab": a.get("vocab") or top["vocab"], "prefixes": top["prefixes"], "takes": []}
        if "prefix" in a:
            now["prefixes"] = top["prefixes"] | dict(re.findall(r"([\w-]+):\s+(\S+)", a["prefix"]))
        for form, scoped, prop in (("microdata", "itemscope" in a, "itemprop"), ("rdfa", "typeof" in a, "property")):
            names = a.get(prop, "").split()
            if scoped:
                types = schema_types(a.get("itemtype", "")) if form == "microdata" else schema_types(a["typeof"], now["vocab"], now["prefixes"])
                now[form] = self._item(form, top, names, types, a.get("itemid") if form == "microdata" else a.get("resource") or a.get("about"))
            elif names and top[form] is not None:
                given = a.get(VALUES.get(name, "")) if form == "microdata" else a.get("content", a.get("resource", a.get("href", a.get("src", a.get("datetime")))))
                given = a.get("content", given) if form == "microdata" else given
                if given is None and name not in VOID:
                    now["takes"].append((top[form], names, []))
                    self.taking.append(now["takes"][-1][2])
                else:
                    for p in names:
                        top[form].put(p, given or "")
        if name not in VOID:
            self.open.append(now)
            self.names[name] = self.names.get(name, 0) + 1

    def text(self, text: str) -> None:
        for parts in self.taking:
            parts.append(text)

    def end(self, name: str) -> None:
        if self.names.get(name):
            while self.close() != name:
                pass

    def close(self) -> str:
        element = self.open.pop()
        self.names[element["name"]] -= 1
        del self.taking[len(self.taking) - len(element["takes"]) :]
        for item, names, parts in element["takes"]:
            for p in names:
                item.put(p, _clean("".join(parts)))
        return element["name"]


_LOGIN_PATH = re.compile(r"(?:^|/)(?:auth|login|log-in|signin|sign-in|sso)(?:/|$)", re.I)
_LOGIN_TITLE = re.compile(r"\b(?:authenticate|log[ -]?in|sign[ -]?in)\b", re.I)


def _path(url: str) -> str:
    return re.sub(r"^[A-Za-z][\w+.-]*://[^/?#]*|[?#].*$", "", url)


_LINK = S.StructType([S.StructField("href", S.StringType()), S.StructField("text", S.StringType()), S.StructField("nofollow", S.BooleanType())])
_ALTERNATE = S.StructType([S.StructField("lang", S.StringType()), S.StructField("href", S.StringType())])
_THING = S.StructType(
    [
        S.StructField("format", S.StringType()), S.StructField("path", S.StringType()), S.StructField("types", S.ArrayType(S.StringType())), S.StructField("id", S.StringType()),
        S.StructField("props", S.MapType(S.StringType(), S.StringType())), S.StructField("same_as", S.ArrayType(S.StringType())),
    ]
)
FIELDS = {
    "title": S.StringType(), "description": S.StringType(), "n_h1": S.IntegerType(), "lang": S.StringType(), "text": S.StringType(), "n_words": S.IntegerType(), "canonical": S.StringType(), "canonical_status": S.StringType(),
    "meta_robots": S.StringType(), "viewport": S.BooleanType(), "og_title": S.BooleanType(), "og_description": S.BooleanType(), "og_image": S.BooleanType(), "twitter_card": S.BooleanType(), "json_ld": S.BooleanType(), "invalid_json_ld": S.IntegerType(),
    "missing_alt": S.IntegerType(), "insecure_parts": S.IntegerType(), "login_form": S.BooleanType(), "alternates": S.ArrayType(_ALTERNATE), "links": S.ArrayType(_LINK), "items": S.ArrayType(_THING),
}


def page_facts(html: str, url: str = "", reading: Reading = STANDARD) -> dict:
    """The FIELDS of a page. Text is what stands outside scripts, styles, titles, navigation and footers."""
    f: dict = {"title": None, "description": None, "n_h1": 0, "lang": None, "meta_robots": [], "missing_alt": 0, "insecure_parts": 0, "invalid_json_ld": 0, "login_form": False, "alternates": [], "links": [], "items": []}
    f |= dict.fromkeys(("viewport", "og_title", "og_description", "og_image", "twitter_card", "json_ld"), False)
    scopes, words, canonicals, hidden, raw, link, form, action = _Scopes(), [], [], 0, "", None, False, ""
    in_head, gates = True, []
    for kind, name, a in tokens(html, reading):
        if kind == "text":
            if raw == "title":
                f["title"] = reading.clean_title(name) if f["title"] is None else f["title"]
            elif raw == "ld":
                f["json_ld"] = True
                found = json_items(name)
                f["items"] += found or []
                f["invalid_json_ld"] += found is None
            elif not raw:
                scopes.text(name)
                if link is not None:
                    link["text"] += name
                if not hidden:
                    words.append(name)
            continue
        if kind == "end":
            words.append(" ")
            raw = "" if name in _RAW_END else raw
            hidden = max(0, hidden - (name in HIDDEN))
            link = None if name == "a" else link
            form = form and name != "form"
            in_head = in_head and name != "head"
            scopes.end(name)
            continue
        words.append(" ")
        if name in _RAW_END:
            raw = "ld" if name == "script" and a.get("type", "").strip().lower() == "application/ld+json" else name
        hidden += name in HIDDEN
        in_head = in_head and name != "body"
        scopes.start(name, a)
        src = a.get("src", "") or (a.get("href", "") if name == "link" and "stylesheet" in a.get("rel", "").lower().split() else "")
        f["insecure_parts"] += src.lower().startswith("http://")
        if name == "html" and f["lang"] is None:
            f["lang"] = a.get("lang")
        elif name == "h1":
            f["n_h1"] += 1
        elif name == "img":
            f["missing_alt"] += "alt" not in a
        elif name == "a" and "href" in a:
            link = {"href": a["href"], "text": "", "nofollow": "nofollow" in a.get("rel", "").lower().split()}
            f["links"].append(link)
        elif name == "form":
            form, action = True, a.get("action", "")
        elif name == "input" and form and a.get("type", "").lower() == "password":
            gates.append(action)
        elif name == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel:
                canonicals.append((a.get("href", "").strip(), in_head))
            if "alternate" in rel and "hreflang" in a:
                f["alternates"].append({"lang": a["hreflang"], "href": a.get("href", "")})
        elif name == "meta":
            key, content = (a.get("name") or a.get("property") or "").strip().lower(), a.get("content", "").strip()
            if key == "description" and f["description"] is None:
                f["description"] = content
            elif key == "robots":
                f["meta_robots"].append(content)
            elif key in ("viewport", "og:title", "og:description", "og:image", "twitter:card"):
                f[key.replace(":", "_")] = True
    while len(scopes.open) > 1:
        scopes.close()
    for x in f["links"]:
        x["text"] = _clean(x["text"])
    here = [h for h, inside in canonicals if inside]
    f["canonical"] = (here or [h for h, _ in canonicals] or [""])[0]
    f["canonical_status"] = ("outside-head-only" if not here else "conflicting" if len(set(here)) > 1 else "duplicate" if len(here) > 1 else "single") if canonicals else "single"
    f["login_form"] = bool(gates) and bool(_LOGIN_PATH.search(_path(url)) or _LOGIN_TITLE.search(f["title"] or "") or _LOGIN_PATH.search(_path(gates[0])))
    text = reading.clean("".join(words))
    f |= {"text": text, "n_words": len(text.split(" ")) if text else 0, "meta_robots": ",".join(f["meta_robots"]), "title": f["title"] or "", "description": f["description"] or "", "lang": f["lang"] or "", "items": f["items"] + scopes.items}
    return f


def extracted(pages: DataFrame, *keep: str, reading: Reading = STANDARD) -> DataFrame:
    """keep and the FIELDS of each page (url, html), in one pass over the html. Null html is an empty page."""
    schema = S.StructType([*(pages.schema[c] for c in keep), *(S.StructField(n, t) for n, t in FIELDS.items())])
    arrow = to_arrow_schema(S.StructType([S.StructField(n, t) for n, t in FIELDS.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                facts = [page_facts(h or "", u or "", reading) for u, h in zip(part.column("_url").to_pylist(), part.column("_html").to_pylist(), strict=True)]
                for x in facts:
                    for item in x["items"]:
                        item["props"] = list(item["props"].items())
                columns = [pa.array([x[field.name] for x in facts], field.type) for field in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*keep, *FIELDS])

    return pages.select(*keep, pages["url"].alias("_url"), pages["html"].alias("_html")).mapInArrow(run, schema)
