"""Whole batches of text as NumPy arrays: characters, classes, runs and hashes without a Python loop per character."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at once; bounds a worker's scratch memory. A longer text is still handled whole, alone.
CHUNK_CHARS = 1 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space or other."""
    codes = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((codes.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@functools.cache
def lower_table() -> np.ndarray:
    """Lower case of every code point that has one of a single character."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1F000):
        if len(low := chr(i).lower()) == 1:
            table[i] = ord(low)
    return table


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def spans(offsets: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most limit bytes, or of one text above it."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


class Chunk:
    """Some consecutive texts: code points, and where each text and character begins."""

    __slots__ = ("bytes", "byte_of", "code", "start", "texts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int):
        first, last = int(offsets[low]), int(offsets[high])
        self.bytes = data[first:last]
        self.texts = high - low
        here = offsets[low : high + 1] - first
        leads = np.flatnonzero((self.bytes & 0xC0) != 0x80)
        if len(leads) == len(self.bytes):
            self.code, self.start = self.bytes.astype(np.uint32), here.astype(np.int64)
        else:
            self.code = np.frombuffer(self.bytes.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            self.start = np.searchsorted(leads, here)
        self.byte_of = np.append(leads, len(self.bytes))

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each of the given character positions."""
        return np.searchsorted(self.start, positions, side="right") - 1


def chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, Chunk]]:
    data, offsets = utf8_parts(column)
    for low, high in spans(offsets, limit):
        yield low, Chunk(data, offsets, low, high)


@functools.lru_cache(maxsize=12)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = 1 << bits
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 result bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int = CHUNK_CHARS) -> np.ndarray:
    """64-bit hash of each run values[begin:end]; equal runs have equal hashes wherever they stand.

    begin must ascend. Long arrays are handled in stretches of about limit values, so scratch memory stays bounded.
    """
    out = np.empty(len(begin), np.uint64)
    low = 0
    while low < len(begin):
        origin = int(begin[low])
        high = max(low + 1, int(np.searchsorted(end, origin + limit, side="right")))
        out[low:high] = _hashes(values[origin : int(end[high - 1])], begin[low:high] - origin, end[low:high] - origin)
        low = high
    return out


def _hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(max(12, int(len(values)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(0x51)) * up[: len(values)])])
        raw = (total[end] - total[begin]) * down[begin]
        return mix64(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
