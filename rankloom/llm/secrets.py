"""Secret scans: fixed credential patterns, and windows of high Shannon entropy in candidate strings.

A window slides over each candidate; the counts of its characters, and with them its entropy, are updated by the one character that
enters and the one that leaves. An allow-list takes back findings that are known not to be secrets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order of their listing, with the least length of the checked group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Findings of the entropy scan that are no secrets: UUIDs, placeholders, numbers; and strings without MIXED, whose parts are plain words or
#: short numbers joined by dashes, slashes or underscores.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|x{6}|your[_-]?(key|token|secret)|lorem",
    r"^[0-9_/+=-]+$",
]
MIXED = r"[a-z][A-Z0-9]|[A-Z]{2}[a-z]|[0-9][A-Za-z]|[A-Z][0-9]|[0-9]{5}"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of these characters are windows of one class; a window at or above `bits` of entropy a character is a finding."""

    name: str
    alphabet: str
    window: int
    bits: float


#: From the narrowest to the widest; a candidate belongs to the first class that holds all its characters.
CLASSES = [
    CharacterClass("hex", "0123456789abcdefABCDEF", 24, 3.2),
    CharacterClass("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, 3.9),
    CharacterClass("base64", "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-", 20, 3.9),
]


#: Values that one step of running() copies at most.
BLOCK = 128
#: Counts of characters in a window take COUNT_BITS bits each, PER_WORD of them a long; sums of c * log2(c) count in parts of SCALE.
COUNT_BITS, PER_WORD, SCALE = 5, 12, 1 << 40


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, combine, zero: Column) -> Column:
    """The array of combine(...) over all values so far, for an associative combine: within blocks, and over the blocks before."""
    block = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    within = lambda xs: F.slice(F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))), F.lit(2), F.lit(BLOCK))

    def shifted(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(zero), lambda acc, part: F.concat(acc, F.array(combine(F.element_at(acc, -1), F.element_at(part, -1)))))
        return let(before, lambda at: F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda x: combine(F.element_at(at, i + 1), x)))))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: within(block(b)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, shifted))


def _located(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of all leftmost matches that don't overlap and pass keep(match). The pieces between the matches give their places."""
    none = F.array().cast(SPANS)

    def spans(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = let(lengths, lambda n: running(n, lambda a, b: a + b, F.lit(0)))
        span = lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), hit.alias("text"))
        return F.filter(F.zip_with(hits, ends, span), lambda s: keep(s["text"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(spans(hits)))


def window_entropy(s: Column, cls: CharacterClass) -> Column:
    """The highest entropy, in bits a character, of any window of s; all of s if it is shorter than a window.

    The state is the count of each character of the class, packed into longs, and the sum of c * log2(c); a step changes two counts.
    """
    n = F.least(F.length(s), F.lit(cls.window))
    total = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(cls.window + 2)]
    growth = F.array(*[F.lit(after - before).cast("long") for before, after in zip(total, total[1:])])  # noqa: B905
    words = [f"w{j}" for j in range(-(-len(cls.alphabet) // PER_WORD))]
    first = F.struct(*[F.lit(0).cast("long").alias(w) for w in words], F.lit(0).cast("long").alias("sum"), F.lit(-1.0).alias("best"))
    word, bit = (lambda x: (x / PER_WORD).cast("int")), (lambda x: x % PER_WORD * COUNT_BITS)

    def count(acc: Column, x: Column) -> Column:
        held = acc[words[-1]]
        for j in range(len(words) - 2, -1, -1):
            held = F.when(word(x) == j, acc[words[j]]).otherwise(held)
        return F.call_function("shiftright", held, bit(x)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def changed(acc: Column, x: Column, by: int) -> list[Column]:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(x)) * by
        return [F.when(word(x) == j, acc[w] + one).otherwise(acc[w]).alias(w) for j, w in enumerate(words)]

    def step(acc: Column, i: Column, at: Column) -> Column:
        new, old = F.element_at(at, i), F.element_at(at, i - n)
        enter = F.struct(*changed(acc, new, 1), (acc["sum"] + F.element_at(growth, count(acc, new) + 1)).alias("sum"), acc["best"].alias("best"))
        leave = lambda a: F.when(i > n, F.struct(*changed(a, old, -1), (a["sum"] - F.element_at(growth, count(a, old))).alias("sum"), a["best"].alias("best"))).otherwise(a)
        entropy = lambda a: F.log2(n.cast("double")) - a["sum"] / SCALE / n
        note = lambda a: F.when(i >= n, F.struct(*[a[w].alias(w) for w in words], a["sum"].alias("sum"), F.greatest(a["best"], entropy(a)).alias("best"))).otherwise(a)
        return let(let(enter, leave), note)

    places = F.transform(F.split(s, "", -1), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    return let(places, lambda at: F.aggregate(F.sequence(F.lit(1), F.length(s)), first, lambda acc, i: step(acc, i, at), lambda acc: acc["best"]))


def _class_of(s: Column, then) -> Column:
    """then(class) of the first class that holds all characters of s."""
    out = F.lit(False)
    for cls in reversed(CLASSES):
        chars = cls.alphabet.replace("-", "") + ("-" if "-" in cls.alphabet else "")
        out = F.when(s.rlike(f"^[{chars}]+$"), then(cls)).otherwise(out)
    return out


def is_entropic(s: Column) -> Column:
    """Whether some window of s, in its character class, is as uneven as a key; allow-listed strings never are."""
    allowed = ~s.rlike(MIXED)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    # two of the three kinds of characters at least: plain words of natural languages have one
    kinds = sum(s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return F.when(allowed | (kinds < 2), F.lit(False)).otherwise(_class_of(s, lambda c: window_entropy(s, c) >= c.bits))


def _without_touching(spans: Column) -> Column:
    """Sorted spans without the entropy spans that overlap a base span: one that begins before and ends later, or one that begins within."""
    is_base = lambda s: s["kind"] < KINDS.index("entropy")
    far = F.lit(2**31 - 1)
    ends = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
    starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), F.least, far))
    free = lambda s, i, before, after: is_base(s) | ((F.element_at(before, i + 1) <= s["start"]) & (F.element_at(after, i + 1) >= s["end"]))
    return let(ends, lambda before: let(starts, lambda after: F.filter(spans, lambda s, i: free(s, i, before, after))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_entropy and spans, an array of (start, kind, end, text) by start.

    Offsets count code points, ends are exclusive. Base kinds overlap freely with each other; an entropy span is a whole candidate
    string that touches no base span. Null texts count as empty and have no spans. Repeated rows are scanned each; an empty table
    gives no rows; other columns are ignored. The time is linear in the length of a text and of its candidates.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _located(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _located(text, ACCESS, "access", lambda m: F.length(m) >= 16),
        # runs under 32 characters fail; leaving them out of the pattern changes no other match
        _located(text, r"[0-9a-f]{32,}", "hex", lambda m: F.length(m) >= 32),
    )
    found = docs.select(F.col(id_col).alias("doc_id"), base.alias("base"), _located(text, CANDIDATE, "entropy", is_entropic).alias("more"))
    spans = F.when(F.size("more") == 0, F.array_sort("base")).otherwise(let(F.array_sort(F.concat("base", "more")), _without_touching))
    found = found.select("doc_id", spans.alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], "spans")


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    shown = F.filter(spans, lambda s: s["kind"] < KINDS.index("entropy")) if base_only else spans
    name = lambda k: F.element_at(F.lit(KINDS), k + 1)
    return F.array_join(F.transform(shown, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
