"""Words of many texts at once: their places and checksums, by array operations over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A longer text is read on its own; texts under it share arrays.
SLICE_BYTES = 4_000_000
#: Words of up to so many bytes are summed side by side.
SHORT = 48


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows of about `most` bytes. Null texts are empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the longest runs of bytes that in_word (256 flags) allows; no word goes beyond its row."""
    inside = in_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _byte_steps() -> np.ndarray:
    """What a byte does to a CRC-32, by the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_STEP = _byte_steps()


def _shifts() -> np.ndarray:
    """[n, byte of the checksum, its value]: the checksum after n more bytes, up to what these bytes add by themselves."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _STEP[out[n] & np.uint32(255)]
    return out


_SHIFT = _shifts()


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    lengths = ends - starts
    order = np.argsort(SHORT + 1 - np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")  # the longest first
    at, short = starts[order], lengths[order]
    n_of = len(order) - np.searchsorted(np.sort(lengths), np.arange(SHORT + 1), "right")  # words with more than k bytes
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(SHORT):
        n = n_of[k]
        if not n:
            break
        crc[:n] = (crc[:n] >> np.uint32(8)) ^ _STEP[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n_of[SHORT]):
        crc[i] = zlib.crc32(data[at[i] : at[i] + short[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _after(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of crc in the checksum of a text that goes on for so many bytes."""
    rest = lengths.copy()
    while len(long := np.flatnonzero(rest > SHORT)):
        c = crc[long]
        crc = crc.copy()
        crc[long] = _SHIFT[SHORT, 0, c & 255] ^ _SHIFT[SHORT, 1, (c >> 8) & 255] ^ _SHIFT[SHORT, 2, (c >> 16) & 255] ^ _SHIFT[SHORT, 3, c >> 24]
        rest[long] -= SHORT
    return _SHIFT[rest, 0, crc & 255] ^ _SHIFT[rest, 1, (crc >> 8) & 255] ^ _SHIFT[rest, 2, (crc >> 16) & 255] ^ _SHIFT[rest, 3, crc >> 24]


def joined(crc: np.ndarray, next_crc: np.ndarray, next_lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts joined by a space, from the CRC-32 of each and the length of the second."""
    c = crc ^ np.uint32(0xFFFFFFFF)
    spaced = ((c >> np.uint32(8)) ^ _STEP[(c ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)
    return _after(spaced, next_lengths) ^ next_crc
