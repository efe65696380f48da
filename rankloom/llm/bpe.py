"""BPE encoding and decoding by a traversal of the trie of distinct words.

The last token of a word's encoding depends on the word alone, and dropping it leaves the encoding of a shorter prefix. So each node of
the trie of words needs one state, its last token, found from the states above it. Words are visited depth first: of the path to a word
only what it doesn't share with the word before is computed.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import releasing

END = "</w>"
#: Words whose encodings a task holds at most, and pairs of tokens; it starts anew beyond.
MOST_WORDS, MOST_PAIRS = 120_000, 200_000

_UNMET: dict[str, bool] = {}


class WordTrie:
    """Encodes words, strings of byte symbols, by the merges of a BPE model with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab, self.rank = vocab, {pair: i for i, pair in enumerate(merges)}
        self.longest = max((len(t.removesuffix(END)) for t in vocab), default=1)
        #: How each token comes about when its own symbols are merged: (rank of the last merge, left part, right part); single symbols
        #: have no parts; tokens that merging never gives are left out.
        self.made: dict[str, tuple[int, str, str]] = {t: (-1, "", "") for t in vocab if len(t.removesuffix(END) or t) == 1}
        for rank, (left, right) in enumerate(merges):
            if left in self.made and right in self.made and left + right not in self.made and self._apart(left, right, rank):
                self.made[left + right] = (rank, left, right)
        #: By token, the tokens that it may follow or not, as far as it is known; all tokens share the empty table until they are met.
        self.fits: dict[str, dict[str, bool]] = dict.fromkeys(self.made, _UNMET)
        self.n_pairs = self.n_steps = 0

    def _apart(self, left: str, right: str, limit: int) -> bool:
        """Whether merging both together gives left and right as they stand, up to the merge of rank `limit`.

        Their merges are undone from the last to the first. Before each one, the two tokens at the border are those that stood there
        at that time; if they have a merge of a lower rank than those still to come, it would have crossed the border. At the same
        rank, the one further left goes first.
        """
        made, rank = self.made, self.rank
        a, b = left, right
        until = (limit, 0)
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and (crossing, 1) < until:
                return False
            at, bt = made[a][0], made[b][0]
            if at < 0 and bt < 0:
                return True
            if at > bt:
                until, a = (at, 0), made[a][2]
            else:
                # a merge right of the border comes after a crossing one of the same rank
                until, b = (bt, 2), made[b][1]

    def _follows(self, last: str, token: str) -> bool:
        """Whether merging both together leaves them apart."""
        self.n_pairs += 1
        if self.n_pairs > MOST_PAIRS:
            self.n_pairs = 0
            self.fits = dict.fromkeys(self.made, _UNMET)
        if self.fits[token] is _UNMET:
            self.fits[token] = {}
        fits = self.fits[token][last] = self._apart(last, token, 1 << 60)
        return fits

    def _extend(self, word: str, size: int, end: str, states: list[str]) -> None:
        """Appends the last token of every prefix up to `size` symbols, the longest with `end`."""
        longest, done = self.longest, len(states)
        self.n_steps += size - done
        for upto in range(done + 1, size + 1):
            tail = end if upto == size else ""
            for start in range(upto - 1, max(-1, upto - longest - 1), -1):
                token = word[start:upto] + tail
                if (known := self.fits.get(token)) is not None:
                    if not start:
                        break
                    last = states[start - 1]
                    if (fit := known.get(last)) is None:
                        fit = self._follows(last, token)
                    if fit:
                        break
            else:
                raise ValueError(f"no token ends the prefix {word[:upto]!r}")
            states.append(token)

    def encode(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word, depth first through their trie."""
        vocab, states, before = self.vocab, [], ""
        for word in sorted(words):
            shared, inner = 0, len(word) - 1
            limit = min(len(states), inner)
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del states[shared:]
            self._extend(word, len(word), END, states)
            token = states.pop()
            ids, at = [vocab[token]], len(word) - len(token) + len(END)
            while at:
                token = states[at - 1]
                ids.append(vocab[token])
                at -= len(token)
            before = word
            yield word, ids[::-1]


#: Letters and numbers of the Latin blocks, which every version of Unicode has in the same classes; other characters go through the
#: library's own normaliser and splitting.
_LATIN = [chr(c) for c in range(0x21, 0x250)]
_LETTERS, _NUMBERS = (re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind)) for kind in "LN")
_OTHER = re.compile(r"[^\t\n\v\f\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, n = [chr(b) for b in range(256)], 0
    for b in range(256):
        if b not in own:
            table[b], n = chr(0x100 + n), n + 1
    return table


#: The settings for which _PIECE and lower() do the same as the library on Latin texts; other files go through the library's own.
_LATIN_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def check_settings(parsed: dict) -> None:
    """Raises ValueError for files of other kinds of models than the trie encodes."""
    model = parsed["model"]
    want = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}
    if other := {k: model[k] for k, v in want.items() if (model.get(k) or None) != (v or None)}:
        raise ValueError(f"only BPE models with word ends {END} and plain merges are encoded; this file has {other}")
    before = parsed.get("pre_tokenizer") or {}
    last = before["pretokenizers"][-1] if before.get("type") == "Sequence" and before["pretokenizers"] else before
    if last.get("type") != "ByteLevel":
        raise ValueError("only files whose words end up as byte symbols (ByteLevel) are encoded")
    if odd := [t["content"] for t in parsed.get("added_tokens") or [] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]:
        raise ValueError(f"added tokens that are matched in other ways than as they stand: {odd}")


class Encoder:
    """Texts to ids and back, as the tokenizer file describes; word encodings come from a trie.

    Files with another normaliser, splitting of words or decoder than _LATIN_SETTINGS are read through the library's; models that the
    trie doesn't stand for raise ValueError.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        check_settings(parsed)
        library = Tokenizer.from_str(spec)  # for its normaliser, its splitting of words and its decoder only
        self.normalize = library.normalizer.normalize_str if parsed.get("normalizer") else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.latin = all(parsed.get(k) == v for k, v in _LATIN_SETTINGS.items())
        self.decoder = library if parsed.get("decoder") else None
        model = parsed["model"]
        self.added = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
        #: Of added tokens that begin at the same place the longest counts.
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.trie = WordTrie(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.symbols = _byte_symbols()
        #: Encodings of pieces, as they stand in the text and in byte symbols.
        self.words: dict[str, bytes] = {}
        self.mapped: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """(piece, whether it is an added token), in order."""
        pieces, at = [], 0
        for m in self.find_added.finditer(text) if self.find_added else ():
            pieces += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*pieces, (text[at:], False)] if x[0]]

    def _learn(self, words: set[str], mapped: set[str]) -> None:
        """Adds the encodings of pieces that aren't known yet."""
        of = {w: w if w.isascii() else "".join([self.symbols[b] for b in w.encode()]) for w in words}
        packed = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in self.trie.encode({*of.values(), *mapped})}
        self.words.update((w, packed[m]) for w, m in of.items())
        self.mapped.update((m, packed[m]) for m in mapped)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.mapped) > MOST_WORDS:
            self.words.clear()
            self.mapped.clear()
        parts: list[list[tuple[dict[str, bytes] | None, list[str]]]] = []
        for text in texts:
            pieces = []
            for piece, added in self._pieces(text):
                if added:
                    pieces.append((None, [piece]))
                elif not self.latin or _OTHER.search(piece):
                    pieces.append((self.mapped, [p for p, _ in self.split(self.normalize(piece))]))
                else:
                    pieces.append((self.words, _PIECE.findall(piece.lower())))
            parts.append(pieces)
        new, mapped = set(), set()
        for pieces in parts:
            for known, found in pieces:
                if known is not None:
                    (new if known is self.words else mapped).update(found)
        new.difference_update(self.words)
        mapped.difference_update(self.mapped)
        if new or mapped:
            self._learn(new, mapped)
        return [b"".join([struct.pack("<I", self.added[found[0]]) if known is None else b"".join(map(known.__getitem__, found)) for known, found in pieces]) for pieces in parts]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces where the file names no decoder."""
        if self.decoder is not None:
            return self.decoder.decode(memoryview(ids).cast("I").tolist() if ids else [], skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I") if ids else ()))


#: Rows whose words are looked up together.
ROWS = 512


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (packed little-endian unsigned 32-bit integers) and decoded, the text of these ids.

    The tokenizer file is read on the driver and broadcast; its size doesn't grow with the data. Null and empty texts have no ids and
    decode to the empty text. Repeated rows are encoded each; an empty table gives no rows; other columns are ignored. A byte for which
    the file has no token, and a file of another kind of model (check_settings), raises ValueError. The encoder lives as long as its task.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    check_settings(json.loads(text))
    spec = sc.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                decoded = list(map(encoder.decode, ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(run), f"doc_id {kind}, ids binary, decoded string")
