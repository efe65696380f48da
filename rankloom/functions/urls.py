"""http(s) URLs as browsers read and write them, by the URL standard."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEFAULT_PORTS = {"http": 80, "https": 443}
#: What is percent-encoded in a path and in a query, beside control characters and everything beyond ASCII.
PATH_ENCODED, QUERY_ENCODED = ' "#<>?^`{}', " \"#<>'"
_FORBIDDEN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_DOT, _DOTS = re.compile(r"(?i)\.|%2e"), re.compile(r"(?i)(?:\.|%2e){2}")


def _encode(text: str, also: str) -> str:
    return "".join(c if " " < c < "\x7f" and c not in also else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host whose last label is a number, of decimal, octal or hexadecimal parts; null if it isn't an address."""
    labels = host.removesuffix(".").split(".")
    try:
        parts = [int(p[2:] or "0", 16) if p[:2] in ("0x", "0X") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in labels if re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", p) or int("x")]
    except ValueError:
        return None
    if len(parts) > 4 or any(p > 255 for p in parts[:-1]) or parts[-1] >= 256 ** (5 - len(parts)):
        return None
    whole = parts[-1] + sum(p << 8 * (3 - i) for i, p in enumerate(parts[:-1]))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    """Lower case, without leading zeros, the first longest run of zeros left out."""
    import ipaddress

    try:
        number = int(ipaddress.IPv6Address(text)) if "%" not in text else None
    except ValueError:
        return None
    if number is None:
        return None
    groups = [f"{number >> s & 0xFFFF:x}" for s in range(112, -1, -16)]
    runs = [(len(m[0]), m.start()) for m in re.finditer("z+", "".join("z" if g == "0" else "x" for g in groups)) if len(m[0]) > 1]
    if not runs:
        return ":".join(groups)
    size, at = max(runs, key=lambda r: (r[0], -r[1]))
    return ":".join(groups[:at]) + "::" + ":".join(groups[at + size :])


def _host(text: str) -> str | None:
    if text.startswith("["):
        inner = _ipv6(text[1:-1]) if text.endswith("]") else None
        return None if inner is None else f"[{inner}]"
    try:
        name = unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return None
    # soft hyphens, invisible spaces and selectors go, full stops of all scripts are full stops
    name = unicodedata.normalize("NFKC", re.sub(r"[\u00ad\u200b\u2060\ufeff\ufe00-\ufe0f]", "", name).lower()).lower()
    labels = re.sub(r"[\u3002\uff0e\uff61]", ".", name).split(".")
    ascii_labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    if any(x == "xn--" or len(x) > 63 and not y.isascii() for x, y in zip(ascii_labels, labels, strict=True)):
        return None
    host = ".".join(ascii_labels)
    if not host or _FORBIDDEN.search(host):
        return None
    last = (labels[:-1] if labels[-1] == "" and len(labels) > 1 else labels)[-1]
    return _ipv4(host) if re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", last) else host


def parse(url: str) -> tuple[str, str, int | None, str, str | None] | None:
    """Scheme, host, port (null for the usual one), path and query of an absolute http(s) URL; null for others. Credentials and the
    fragment are left out."""
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = re.match(r"(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?", text)
    if not m:
        return None
    scheme, authority = m[1].lower(), m[2].rpartition("@")[2]
    host_text, port_text = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", authority, re.S).groups() if re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", authority, re.S) else ("", None)
    host = _host(host_text)
    if host is None or port_text and not (port_text.isascii() and port_text.isdigit() and int(port_text) < 65536):
        return None
    port = int(port_text) if port_text else None
    stack, segments = [], re.split(r"[/\\]", m[3])[1:] or [""]
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if _DOTS.fullmatch(s):
            del stack[-1:]
            stack += [""] * last
        elif _DOT.fullmatch(s):
            stack += [""] * last
        else:
            stack.append(_encode(s, PATH_ENCODED))
    return scheme, host, None if port == DEFAULT_PORTS[scheme] else port, "/" + "/".join(stack), None if m[4] is None else _encode(m[4], QUERY_ENCODED)


def normal(url: str) -> str | None:
    """The URL as the standard writes it, without credentials and fragment."""
    if (parts := parse(url)) is None:
        return None
    scheme, host, port, path, query = parts
    return f"{scheme}://{host}{'' if port is None else f':{port}'}{path}{'' if query is None else f'?{query}'}"


@F.arrow_udf(StringType())
def _normal(urls: pa.Array) -> pa.Array:
    known: dict[str, str | None] = {}
    out = []
    for u in urls.to_pylist():
        if u is not None and u not in known:
            known[u] = normal(u)
        out.append(None if u is None else known[u])
    return pa.array(out, pa.string())


def http_url(url: Column) -> Column:
    """An absolute http(s) URL in its normal form, without credentials and fragment; null for anything else."""
    return _normal(url)
