"""Text columns: folding, pattern terms, title widths, word counts, hashes. All but compatibility forms stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import characters, graphemes, plain, tidy

# --- folding ---------------------------------------------------------------------------------------------------------------------------


def normal_text(text: Column) -> Column:
    """Compatibility parts without diacritics, with straight apostrophes, in lower case, white space as one space; null stays null."""
    return tidy(F.lower(F.translate(plain(text), "‘’", "''")))


def link_text(text: Column) -> Column:
    """Letters, digits and apostrophes of the normalised text; what stands between becomes one space."""
    return F.trim(F.regexp_replace(normal_text(text), r"[^\p{L}\p{N}']+", " "))


# --- pattern terms ---------------------------------------------------------------------------------------------------------------------

#: Words that say nothing about what a query is for, and those that say nothing about its theme either.
QUERY_STOPWORDS = "a an and are best for first from how in is last letter letters name names of on or start starts starting that the to vs with".split()
THEME_STOPWORDS = (
    QUERY_STOPWORDS
    + "about after all at be by can chart check day days did do does each ever find free get high hour hours into low made make makes many month months much near new "
    "page pages per search show site sites than they this time times today tool tools top what when where year years you your".split()
)


def pattern_text(text: Column) -> Column:
    """Apostrophes inside words go, & becomes "and", everything but letters and digits becomes one space; in lower case."""
    joined = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])['’](?=[\p{L}\p{N}])", "")
    return F.trim(F.regexp_replace(F.replace(F.lower(joined), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def _useful(words: Column, stopwords: list[str]) -> Column:
    """Words of two characters or more, single digits, and single characters beyond ASCII, without the stop words."""
    return F.array_except(F.filter(words, lambda w: (F.length(w) > 1) | w.rlike(r"^[0-9]$|[^\x00-\x7F]")), F.array(*[F.lit(w) for w in stopwords]))


def pattern_terms(query: Column) -> Column:
    """The distinct terms of a query, in order."""
    return F.array_distinct(_useful(F.split(pattern_text(query), " "), QUERY_STOPWORDS))


def theme_terms(query: Column) -> Column:
    return _useful(F.split(pattern_text(query), " "), THEME_STOPWORDS)


def stem(term: Column) -> Column:
    """The singular of plain English plurals, and one word for a few that mean the same; other terms stay."""
    n = F.length(term)
    plain = term.rlike("^[a-z]+$") & ~term.rlike("(as|is|ss|us)$") & (n > 4)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    return (
        F.when(term.isin("surname", "surnames"), "name")
        .when(term.isin("beginning", "begins", "started"), "start")
        .when(plain & term.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(plain & term.endswith("xes"), cut(2))
        .when(plain & term.endswith("s"), cut(1))
        .otherwise(term)
    )


def term_coverage(terms: Column, words: Column) -> Column:
    """The share of terms with which some word begins; null where there are no terms."""
    met = F.filter(terms, lambda t: F.exists(words, lambda w: w.startswith(t)))
    return F.when(F.size(terms) > 0, F.size(met) / F.size(terms))


def mentions(text: Column, aliases: list[str]) -> Column:
    """Whether the text has one of the aliases between characters that are neither letters nor digits."""
    quoted = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in a.lower()) for a in aliases]
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(quoted) + r")(?![\p{L}\p{N}])")


# --- widths and counts -----------------------------------------------------------------------------------------------------------------

#: Advances in pixels of a sans-serif face at 20 pixels, and how much pairs of letters move together.
ADVANCES = {
    3.8: "'", 4.4: "ijl‘’", 5.2: "|", 5.6: " !,;:./\\[]ftI ", 6.7: "-(){}`r", 7.0: "•", 7.1: '"“”', 7.8: "*", 9.4: "^", 10.0: "cJksvxyz", 11.1: "?_#$0123456789abdeghnopquL–", 11.7: "+<=>~",
    12.2: "FTZ", 13.3: "&ABEKPRSVXY", 14.4: "CDHNUw", 15.6: "GOQ", 16.7: "mM…", 17.8: "%", 18.9: "W", 20.0: "—", 20.3: "@",
}
KERNING = {"AV": -1.5, "VA": -1.5, "AW": -0.7, "WA": -0.7, "To": -2.2, "Ta": -2.2, "Te": -2.2, "Ty": -1.1, "Yo": -1.8, "LT": -1.5, "FA": -1.1, "PA": -1.5, "We": -0.4}
TITLE_PIXELS, NEAR_PIXELS, WIDE, PICTURE, OTHER = 580, 30, 20.0, 23.0, 11.1
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: What stands for a character that has no advance of its own: a picture, a wide one, another Latin letter, any other.
_PICTURE, _WIDE, _LATIN, _OTHER = "\ue000", "\ue001", "\ue002", "\ue003"


@cache
def _latin_bases() -> dict[str, str]:
    """Latin letters with marks, and the plain letters below the marks."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2C00)}
    return {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])}


def title_shapes(title: Column) -> Column:
    """A title with one character for each that a reader sees: itself where its advance is known, a letter for the same letter with
    marks, else a stand-in for its kind. Loose marks and invisible characters have none."""
    latin, known = _latin_bases(), "".join(ADVANCES.values())

    def shape(g: Column) -> Column:
        letter = F.translate(F.regexp_replace(g, r"\p{M}+", ""), "".join(latin), "".join(latin.values()))
        picture = g.rlike(f"[{characters(r'[\p{Extended_Pictographic}\p{Emoji_Presentation}\p{Regional_Indicator}\u20e3]')}]")
        return (
            F.when((F.length(g) == 1) & F.lit(known).contains(g), g).when(g.rlike(r"^[\p{M}\p{Cf}]+$"), "").when(letter.rlike("^[A-Za-z]$"), letter).when(picture, _PICTURE).when(g.rlike(rf"^(?:{CJK}|\p{{M}})+$"), _WIDE)
            .when(g.rlike(r"^\p{IsLatin}\p{M}*$"), _LATIN).otherwise(_OTHER)
        )

    return F.array_join(F.transform(graphemes(tidy(title)), shape), "")


def title_pixels(title: Column) -> Column:
    """The estimated width of a title in a result list, to a tenth of a pixel: advances of what a reader takes for a character, and
    kerning of the letters next to each other."""
    base = title_shapes(title)
    number = lambda without: F.length(base) - F.length(without)
    total = F.lit(0.0)
    for advance, chars in [*ADVANCES.items(), (PICTURE, _PICTURE), (WIDE, _WIDE), (OTHER, _LATIN + _OTHER)]:
        total = total + number(F.translate(base, chars, "")) * advance
    for pair, move in KERNING.items():
        total = total + number(F.replace(base, F.lit(pair), F.lit(""))) / 2 * move
    return F.floor(total * 10 + 0.5 + 1e-9) / 10


def title_confidence(title: Column) -> Column:
    """How sure the width is: low with a character of no known kind, medium with one whose kind alone is known."""
    shapes = title_shapes(title)
    return F.when(shapes.contains(_OTHER), "low").when(shapes.rlike(f"[{_PICTURE}{_WIDE}{_LATIN}]"), "medium").otherwise("high")


def title_status(pixels: Column) -> Column:
    return F.when(pixels > TITLE_PIXELS, "over-reference").when(pixels >= TITLE_PIXELS - NEAR_PIXELS, "near-reference").otherwise("within-reference")


def cjk_words(text: Column) -> Column:
    """Words: each Chinese, Japanese or Korean character, and each run of other characters between them or white space."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"{CJK}|(?:(?!{CJK})\S)+"), F.lit(0)))


#: Intents in the order in which they are listed.
INTENTS = ["informational", "navigational", "commercial", "transactional"]


def ordered_intents(text: Column) -> Column:
    """The known intents of a list that commas, semicolons or bars separate, in the fixed order, joined by commas."""
    given = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[,;|]"), lambda x: F.trim(x))
    return F.array_join(F.filter(F.array(*[F.lit(i) for i in INTENTS]), lambda i: F.array_contains(given, i)), ",")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the characters' numbers, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


#: Names of fields and URL parameters whose values are not shown.
SENSITIVE = r"(?i)((?:api[_-]?key|access[_-]?token|auth|authorization|client[_-]?secret|password|secret|session|token)=)[^&#\s]*"


def redact(url: Column) -> Column:
    return F.regexp_replace(url, SENSITIVE, "$1[redacted]")


# --- kinds of queries ------------------------------------------------------------------------------------------------------------------

#: Kinds in the order in which they are looked for, by words and phrases of the query.
UNITS = "aud cad celsius csv doc docx eur fahrenheit gbp gram grams inch inches jpeg jpg json kg kilogram kilograms km litre litres meter meters miles mp3 mp4 pdf png pounds usd xml".split()
PATTERN_KINDS = [
    ("comparison", ["vs", "versus", "compare", "comparison"]), ("alternatives", ["alternative", "alternatives"]), ("conversion", ["convert", "converter", "conversion"]), ("template", ["template", "templates"]),
    ("examples", ["example", "examples", "inspiration"]), ("integration", ["integration", "integrations", "sync", "connect"]), ("utility", ["calculator", "generator", "checker", "lookup", "grader", "tester"]),
    ("glossary", ["what is", "definition", "defined"]), ("curation", ["best"]), ("no-login", ["without account", "without login", "without signing", "without sign in"]), ("workflow-action", ["export", "download", "save"]),
    ("meaning-origin", ["meaning", "origin", "history"]), ("rarity-popularity", ["rare", "rarity", "popular", "popularity"]), ("count-statistic", ["how many", "number of", "people with", "people have"]),
    ("list-facet", ["starting with", "starts with", "start with", "beginning with", "letter"]), ("pricing", ["price", "pricing", "cost", "fee"]), ("reviews-community", ["review", "reviews", "reddit", "forum", "community"]),
    ("docs-how-to", ["guide", "docs", "documentation", "api", "how to"]),
]
#: Kinds that a form of the query tells too.
PATTERN_FORMS = {"conversion": f" ({'|'.join(UNITS)}) (in|to) ({'|'.join(UNITS)}) ", "curation": " top [0-9]+ "}


def pattern_kind(query: Column) -> Column:
    """The first kind that a word, phrase or form of the query tells; general where none does."""
    def kind_of(padded: Column) -> Column:
        def tells(kind: str, phrases: list[str]) -> Column:
            found = reduce(lambda a, b: a | b, [padded.contains(f" {p} ") for p in phrases])
            return found | padded.rlike(PATTERN_FORMS[kind]) if kind in PATTERN_FORMS else found

        return reduce(lambda rest, k: F.when(tells(*k), k[0]).otherwise(rest), reversed(PATTERN_KINDS), F.lit("general"))

    # within a transform the text is prepared once, not for each kind
    return F.element_at(F.transform(F.array(F.concat(F.lit(" "), pattern_text(query), F.lit(" "))), kind_of), 1)


def words_covered(query: Column, text: Column) -> Column:
    """The share of a query's stemmed terms that the text has; 0 for a query without terms."""
    terms, have = (F.transform(pattern_terms(x), stem) for x in (query, text))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.array_contains(have, t))) / F.size(terms)).otherwise(F.lit(0.0))
