"""Chat formatting from an event log.

Events of a conversation are sorted by sequence and folded, one at a time, into its final messages, which are rendered by a template
whose control strings are escaped inside texts, so that the output can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (opening, closing) control strings by role; other roles carry their name in the opening string.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROL = sorted({m for pair in MARKS.values() for m in pair} | set(OTHER), key=len, reverse=True)
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_TOKEN = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROL)), re.S)

SPAN = "array<struct<start:int,end:int>>"
FORMATTED = f"conv_id long, n_messages int, formatted string, loss_spans {SPAN}"


def escape(text: str) -> str:
    """A backslash before every control string and every backslash of the text."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(messages: list[tuple[str | None, str]]) -> tuple[str, list[dict]]:
    """The formatted text and the spans (code points, end exclusive) of the assistant texts in it. A null role is the empty one."""
    out, spans, at = [], [], 0
    for role, text in messages:
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = f"{OTHER[0]}{escape(role or '')}{OTHER[1]}", OTHER[2]
        body = escape(text)
        if role == "assistant":
            spans.append({"start": at + len(before), "end": at + len(before) + len(body)})
        out.append(before + body + after)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() was given."""
    opening = {before: role for role, (before, _) in MARKS.items()} | {OTHER[0]: None}
    messages, role, start = [], "", 0
    for m in _TOKEN.finditer(formatted):
        mark = m[0]
        if mark[0] == "\\":
            continue
        if mark in opening:
            role, start = opening[mark], m.end()
        elif mark == OTHER[1]:
            role, start = unescape(formatted[start : m.start()]), m.end()
        else:
            messages.append((role, unescape(formatted[start : m.start()])))
    return messages


class Fold:
    """The messages of one conversation after the events so far."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}

    def add(self, kind: str | None, message: int | None, role: str | None, text: str | None) -> None:
        """message: a whole text, a new one each time if it has no number; delta: more text; edit: another text; regenerate: the text
        goes, with all messages after it, and deltas fill it again. Events of other kinds, and edits of messages that aren't there, do nothing.
        """
        key, text = ("new", len(self.messages)) if message is None else message, text or ""
        if kind == "message":
            self.messages[key] = [role, [text]]
        elif kind == "delta":
            self.messages.setdefault(key, [role, []])[1].append(text)
        elif kind == "edit" and key in self.messages:
            self.messages[key][1] = [text]
        elif kind == "regenerate" and key in self.messages:
            later = list(self.messages)
            for other in later[later.index(key) + 1 :]:
                del self.messages[other]
            self.messages[key][1] = [text] if text else []

    def done(self) -> list[tuple[str | None, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by conversation and sequence; only the open conversation is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_messages", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    at, fold, rows, held = None, None, [], 0

    def close() -> None:
        nonlocal held
        messages = fold.done()
        text, spans = render(messages)
        rows.append({"conv_id": at, "n_messages": len(messages), "formatted": text, "loss_spans": spans})
        held += len(text)

    for batch in batches:
        for conv, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fold is None or conv != at:
                if fold is not None:
                    close()
                at, fold = conv, Fold()
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            fold.add(kind, message, role, text)
    if fold is not None:
        close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_chats(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, kind, message, role, text) to one row per conversation: conv_id, n_messages, formatted, loss_spans.

    Events are ordered by seq, nulls first; those that tie, by kind, message, role and text. Repeated whole messages without a number
    are messages of their own; with a number, the last one stays. Null texts are empty, a null role is the empty role, rows with a null
    conv_id form one conversation. A conversation is held once, as its own text; an empty table gives no rows.
    """
    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "message", "role", "text")
    return ordered.select("conv_id", "kind", "message", "role", "text").mapInArrow(_fold_sorted, FORMATTED)


def turn_events(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table as events: each is a whole message, in the order of its turn. Ids and turns are cast to long: a
    text that is no number fails."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("message"), "role", "text"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("loss", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            messages = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append({"conv_id": conv, "roles": [r for r, _ in messages], "texts": [t for _, t in messages], "loss": loss, "formatted_chars": len(formatted)})
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, roles, texts, loss and formatted_chars, read from formatted and loss_spans alone."""
    out = "conv_id long, roles array<string>, texts array<string>, loss string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read, out)
