"""Compatibility forms, diacritics and grapheme clusters by the Unicode standard.

Decomposition and composition are no SQL functions, so they go through Arrow in whole columns; clusters and classes of characters are
regular expressions of the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers take it.
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@cache
def characters(prop: str) -> str:
    """The inside of a character class of the JVM with all characters that have a property, by ranges."""
    import regex

    has = regex.compile(prop).match
    codes, ranges = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and has(chr(c))], []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if b > a else rf"\x{{{a:x}}}" for a, b in ranges)


@F.arrow_udf(StringType())
def _nfkd(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, "NFKD")


@cache
def _marks() -> dict[int, None]:
    import regex

    has = regex.compile(r"[\p{Diacritic}\p{Mn}]").match
    return {c: None for c in range(0x110000) if not 0xD800 <= c < 0xE000 and has(chr(c))}


@F.arrow_udf(StringType())
def _plain(text: pa.Array) -> pa.Array:
    marks = _marks()
    # of ASCII only two signs are marks
    strip = lambda t: t.replace("^", "").replace("`", "") if t.isascii() else t.translate(marks)
    return pa.array([None if t is None else strip(t) for t in pc.utf8_normalize(text, "NFKD").to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkd(text: Column) -> Column:
    """Every character as its compatibility parts."""
    return _nfkd(text)


def nfkc(text: Column) -> Column:
    """Compatibility parts put together again as far as they can be."""
    return _nfkc(text)


def plain(text: Column) -> Column:
    """Compatibility parts without diacritics."""
    return _plain(text)


def tidy(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def graphemes(text: Column) -> Column:
    """What a reader takes for one character each: letters with their marks, flags, joined emoji, syllables of Hangul."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
