"""Splitting of oversized texts at natural boundaries.

A text is first cut into atoms: at every sentence end; an atom still above the limit at its clauses, then at any white
space, then by force. The atoms are merged again: all adjacent pairs lie in a heap, the weakest boundary (by force, space,
clause, sentence, blank line) first and the smallest pair first among equals, and a pair is merged while its size and the
overlap fit the limit. Each piece then repeats the end of the piece before, from a natural boundary where there is one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE, CLAUSE, SPACE, NONE = range(4)
LEVELS = ["sentence", "clause", "space", "none"]
_BREAKS = "\n\r\x0b\x0c\x85  "
#: Where each level allows a cut: the white space that goes.
_CUTS = [
    re.compile(rf"(?<=[.!?;])\s+|[^\S{_BREAKS}]*[{_BREAKS}]\s*"),
    re.compile(rf"(?<=[.!?;,|:])\s+|[^\S{_BREAKS}]*[{_BREAKS}]\s*"),
    re.compile(r"\s+"),
]
_PARAGRAPH, _FORCED = 5, 1  # strengths: forced 1, space 2, clause 3, sentence 4, blank line 5


def _trim(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin].isspace():
        begin += 1
    while end > begin and text[end - 1].isspace():
        end -= 1
    return begin, end


def atoms(text: str, limit: int, overlap: int = 0) -> tuple[list[tuple[int, int, int]], int]:
    """Atoms (begin, end, strength of the boundary before) within limit, and the weakest level that was needed."""
    found: list[tuple[int, int, int]] = []
    needed = SENTENCE
    force = max(1, limit - overlap)
    work = [(*_trim(text, 0, len(text)), SENTENCE, _PARAGRAPH)]  # the next one last
    while work:
        begin, end, level, before = work.pop()
        if begin == end:
            continue
        if level > SENTENCE and end - begin <= limit:
            found.append((begin, end, before))
            continue
        needed = max(needed, level)
        if level == NONE:
            found.extend((at, min(end, at + force), before if at == begin else _FORCED) for at in range(begin, end, force))
            continue
        parts, at, strong = [], begin, before
        for gap in _CUTS[level].finditer(text, begin, end):
            parts.append((*_trim(text, at, gap.start()), level + 1, strong))
            at, strong = gap.end(), _PARAGRAPH if level == SENTENCE and gap.group().count("\n") > 1 else 4 - level
        parts.append((*_trim(text, at, end), level + 1, strong))
        work.extend(reversed(parts))
    return found, needed


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], str]:
    """Pieces (begin of the repeated part, begin, end) and the item's boundary, one of LEVELS.

    Every piece, its repeated part included, has at most limit characters, and the repeated part at most overlap. White
    space between pieces is in none of them. A text of white space alone has no piece.
    """
    if limit < 1 or overlap < 0:
        raise ValueError("limit must be at least 1 and overlap at least 0")
    overlap = min(overlap, limit - 1)
    parts, needed = atoms(text, limit, overlap)
    n = len(parts)
    begin, end, strength = [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]
    after, before, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    heap = [(strength[i + 1], end[i + 1] - begin[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, vi, vj = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or version[i] != vi or version[j] != vj:
            continue
        if size + (overlap if before[i] >= 0 else 0) > limit:
            continue
        end[i], after[i] = end[j], after[j]
        alive[j] = False
        version[i] += 1
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strength[after[i]], end[after[i]] - begin[i], i, version[i], version[after[i]]))
        if before[i] >= 0:
            k = before[i]
            heapq.heappush(heap, (strength[i], end[i] - begin[k], k, version[k], version[i]))
    pieces = []
    last = None
    for i in range(n):
        if not alive[i]:
            continue
        start = begin[i]
        if last is not None:
            # The gap before this piece counts too, as the repeated part stands before it as stored.
            gap = begin[i] - last[1]
            room = min(overlap, limit - (end[i] - begin[i]) - gap)
            low = max(last[0], last[1] - max(0, room))
            if low < last[1]:
                at = low
                if low > last[0] and not text[low - 1].isspace():
                    while at < last[1] and not text[at].isspace():
                        at += 1
                    if at >= last[1]:
                        at = low  # no boundary within: repeated by force
                start = _trim(text, at, last[1])[0]
                if start >= last[1]:
                    start = begin[i]
        pieces.append((start, begin[i], end[i]))
        last = (begin[i], end[i])
    return pieces, LEVELS[needed]


def split_items(items: DataFrame, *, kind: Column, item_id: Column, text: Column, limit: Column, overlap: int = 90) -> DataFrame:
    """(kind, item_id, limit, boundary, piece, pieces, overlap, begin, end, text): the pieces of all items above their limit.

    limit is in characters; an item with a null text, or a null limit or one below 1 (no limit), or within its limit has no
    row. boundary is the item's: where it had to be cut. Pieces are numbered from 1; begin and end (characters of the item)
    include the repeated part of length overlap. An oversized item of white space alone has one empty piece. Repeated rows
    are split each; other columns aren't read; an empty table gives an empty result.
    """
    chosen = items.select(kind.cast("string").alias("kind"), item_id.cast("long").alias("item_id"), text.alias("text"), limit.cast("int").alias("limit"))
    chosen = chosen.filter((F.col("limit") >= 1) & (F.char_length("text") > F.col("limit")))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("item_id", T.LongType()), T.StructField("limit", T.IntegerType()), T.StructField("boundary", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "overlap", "begin", "end")), T.StructField("text", T.StringType())])
    names = schema.names
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, i, t, most in zip(*(c.to_pylist() for c in batch.columns)):
                pieces, boundary = split_text(t, most, overlap)
                pieces = pieces or [(0, 0, 0)]
                rows += [(k, i, most, boundary, n, len(pieces), b - a, a, e, t[a:e]) for n, (a, b, e) in enumerate(pieces, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    return chosen.mapInArrow(run, schema)
