"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts become words by array operations that follow the tokenizer's splitting pattern; words known to the lexicon get their
ids by one walk through a memory-mapped minimal transducer; all others are merged exactly by the rank file, once each.
The ids are those of the tokenizer whatever the lexicon holds: it decides the speed only.
"""

from __future__ import annotations

import base64
import dataclasses
import functools
import hashlib
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.arrays import SPACE, Chunk, chunks, class_table, ragged_index, run_hashes
from panelwright.llm.automaton import Chain, Transducer
from panelwright.session import cut, discard, local_path, shared_dir

TOKENIZER = "byte_bpe_50k"
#: Words merged so far that a worker keeps; it is emptied when full.
MEMO_WORDS = 200_000
#: Ids in one batch of results, unless a single text has more.
LIST_VALUES = 1 << 26
#: Most counted words of a corpus that are compiled into its lexicon besides the tokenizer's own; they reach the driver.
TOP_WORDS = 25_000


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    """Rank file of a public tokenizer, in folder or in $TOKENIZERS_DIR or in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), f"{name}.tiktoken")


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the adjacent pair of the lowest rank becomes one part, the leftmost first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@functools.cache
def merger(path: str):
    """Exact merge of a word: the compiled one of tiktoken where it is installed, else merge_word."""
    ranks = load_ranks(path)
    try:
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece
    except ImportError:
        return lambda word: merge_word(word, ranks)


def split_words(chunk: Chunk) -> np.ndarray:
    """First characters of the words of a chunk, ascending.

    The rule is that of the published pattern: contractions, then runs of letters, numbers or other signs with at most one
    blank before them, then white space, of which the last character is left to what follows.
    """
    code, kind = chunk.code, class_table()[chunk.code]
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[chunk.start] = True
    edge[n] = True
    first = edge[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    # White space before something else of the same text: its last character begins anew; a blank takes what follows along.
    follows = np.flatnonzero(first[1:] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    first[follows - 1] = True
    first[follows[code[follows - 1] == 32]] = False
    # Contractions: an apostrophe that begins a word.
    quote = np.flatnonzero((code == 39) & first[:n])
    if len(quote):
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        ends = np.concatenate([edge, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        has1, has2 = ~ends[quote + 1], ~ends[quote + 1] & ~ends[quote + 2]
        short = has1 & np.isin(one, np.array([ord(c) for c in "stmd"], code.dtype))
        pair = one * 65536 + two
        long = has2 & np.isin(pair, np.array([ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")], code.dtype))
        for size, at in ((2, quote[short]), (3, quote[long & ~short])):
            first[at + 1] = False
            rest = at + size
            first[rest[rest < n]] = True
    return np.flatnonzero(first)


class Encoder:
    """A worker's encoder of one tokenizer and lexicon."""

    def __init__(self, ranks_path: str, lexicon: Transducer | Chain):
        self.lexicon, self.merge, self.memo = lexicon, merger(ranks_path), {}

    def _words(self, chunk: Chunk):
        starts = split_words(chunk)
        at = chunk.byte_of[starts]
        length = np.diff(np.append(at, len(chunk.bytes)))
        return starts, at, length, self.lexicon.find(chunk.bytes, at, length)

    def _unseen(self, chunk: Chunk, at: np.ndarray, length: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """For each missing word the number of its entry, and the entries: ids of the distinct words, merged once each."""
        raw, memo, merge = chunk.bytes.tobytes(), self.memo, self.merge
        if len(memo) > MEMO_WORDS:
            memo.clear()
        begin, end = at[missing], at[missing] + length[missing]
        # Words of up to 64 bytes are told apart by a 64-bit hash, longer ones are taken one by one.
        key = run_hashes(chunk.bytes, begin, end)
        long = np.flatnonzero(length[missing] > 64)
        key[long] = np.arange(len(long), dtype=np.uint64)
        _, first, entry = np.unique(key, return_index=True, return_inverse=True)
        ids = []
        for x, y in zip(begin[first].tolist(), end[first].tolist()):
            word = raw[x:y]
            got = memo.get(word)
            if got is None:
                got = merge(word)
                if y - x <= 64:
                    memo[word] = got
            ids.append(got)
        return entry, ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the lists of ids of a column of texts."""
        sizes, values = [np.zeros(1, np.int64)], []
        for _, chunk in chunks(column):
            starts, at, length, found = self._words(chunk)
            missing = np.flatnonzero(found < 0)
            entry, unseen = self._unseen(chunk, at, length, missing)
            extra = np.fromiter(map(len, unseen), np.int64, len(unseen))
            begin = self.lexicon.where[found]
            count = self.lexicon.where[found + 1] - begin
            begin[missing] = len(self.lexicon.pool) + (np.cumsum(extra) - extra)[entry]
            count[missing] = extra[entry]
            pool = np.concatenate([self.lexicon.pool, np.fromiter(itertools.chain.from_iterable(unseen), np.int32, int(extra.sum()))])
            values.append(pool[ragged_index(begin, count)])
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            sizes.append(np.diff(total[np.searchsorted(starts, chunk.start)]))
        return np.cumsum(np.concatenate(sizes)), np.concatenate(values) if values else np.zeros(0, np.int32)

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text, without making them."""
        sizes = []
        for _, chunk in chunks(column):
            starts, at, length, found = self._words(chunk)
            count = self.lexicon.where[found + 1] - self.lexicon.where[found]
            missing = np.flatnonzero(found < 0)
            entry, unseen = self._unseen(chunk, at, length, missing)
            count[missing] = np.fromiter(map(len, unseen), np.int64, len(unseen))[entry]
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            sizes.append(np.diff(total[np.searchsorted(starts, chunk.start)]))
        return np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def whole_words(ranks_path: str) -> dict[bytes, list[int]]:
    """Entries of the tokenizer that are a word of the splitting pattern and merge to themselves: its most frequent words."""
    merge, texts, ranks = merger(ranks_path), [], []
    for word, rank in load_ranks(ranks_path).items():
        try:
            texts.append(word.decode("utf-8"))
            ranks.append(rank)
        except UnicodeDecodeError:
            continue
    undivided: list[bool] = []
    for _, chunk in chunks(pa.array(texts, pa.string())):
        undivided += (np.bincount(chunk.text_of(split_words(chunk)), minlength=chunk.texts) == 1).tolist()
    entries = {text.encode(): [rank] for text, rank, one in zip(texts, ranks, undivided) if one}
    return {word: ids for word, ids in entries.items() if merge(word) == ids}


@dataclasses.dataclass
class Lexicon:
    """Where workers find the compiled lexicon: files to map into memory, or broadcast copies where the shared folder isn't a
    mounted file system. The first is the tokenizer's own, the second, if any, that of a corpus. Their size is bounded by the
    vocabulary and top words."""

    key: str
    parts: list[str | Broadcast]

    def open(self) -> Transducer | Chain:
        found = [Transducer.map(p) if isinstance(p, str) else p.value for p in self.parts]
        return found[0] if len(found) == 1 else Chain(*found)


def _compiled(spark: SparkSession, key: str, entries: Callable[[], dict[bytes, list[int]]]) -> str | Broadcast:
    """The transducer of the entries, as a file of the shared folder made once per key, else broadcast."""
    path = local_path(f"{shared_dir(spark)}/lexicon-{key}.bin")
    if path is None:
        return spark.sparkContext.broadcast(Transducer.build(entries()))
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        Transducer.build(entries()).save(path)
    return path


def build_lexicon(spark: SparkSession, ranks_path: str, frequent: DataFrame | None = None, top: int = TOP_WORDS) -> Lexicon:
    """Compile the lexicon, into files of the shared folder once per content.

    frequent (word, count): further words, of which at most the top most counted are compiled with their exact ids; no more
    rows reach the driver.
    """
    with open(ranks_path, "rb") as ranks:
        digest = hashlib.sha256(ranks.read())
    key = digest.hexdigest()[:24]
    own = _compiled(spark, key, lambda: whole_words(ranks_path))
    if frequent is None:
        return Lexicon(key, [own])
    frequent = cut(frequent, "words")
    # The least count of which at most top words have it or more, by steps of a sixteenth of a power of two.
    step = F.floor(F.log2("count") * 16).cast("int")
    left, least, words = top, None, []
    for r in frequent.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is not None:
        rows = frequent.filter(step >= least).select("word").toArrow().column(0).to_pylist()
        words = sorted(w for w in rows if 0 < len(w) <= 64)
    discard(frequent)
    if not words:
        return Lexicon(key, [own])
    digest.update(b"\0".join(words))
    merge = merger(ranks_path)
    return Lexicon(digest.hexdigest()[:24], [own, _compiled(spark, digest.hexdigest()[:24], lambda: {w: list(merge(w)) for w in words})])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks_path: str, lexicon: Lexicon) -> Encoder:
    if (ranks_path, lexicon.key) not in _ENCODERS:
        _ENCODERS[ranks_path, lexicon.key] = Encoder(ranks_path, lexicon.open())
    return _ENCODERS[ranks_path, lexicon.key]


def word_counts(df: DataFrame, text: str = "text", least: int = 1, ranks_path: str | None = None, known: bool = True) -> DataFrame:
    """(word BINARY, count BIGINT) over all texts, words as the tokenizer splits them; counted per batch before the shuffle.

    Without known, words that are one id of the tokenizer are left out: they are in every lexicon. So are words of over 64
    bytes, which no lexicon holds.
    """
    spark, ranks_path = df.sparkSession, ranks_path or tokenizer_path()
    lexicon = None if known else build_lexicon(spark, ranks_path)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for _, chunk in chunks(batch.column(0)):
                at = chunk.byte_of[split_words(chunk)]
                end = np.append(at[1:], len(chunk.bytes))
                if lexicon is not None:
                    kept = (_encoder(ranks_path, lexicon).lexicon.find(chunk.bytes, at, end - at) < 0) & (end - at <= 64)
                    at, end = at[kept], end[kept]
                _, first, n = np.unique(run_hashes(chunk.bytes, at, end), return_index=True, return_counts=True)
                raw = chunk.bytes.tobytes()
                for begin, stop, times in zip(at[first].tolist(), end[first].tolist(), n.tolist()):
                    word = raw[begin:stop]
                    counts[word] = counts.get(word, 0) + times
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = df.select(F.col(text).alias("text")).mapInArrow(partial, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("count")).filter(F.col("count") >= least)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", ids: str = "ids", ranks_path: str | None = None, frequent: DataFrame | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of every row's text as stored, without special tokens.

    An empty text and a null text have the empty list. Repeated rows stay repeated, other columns are not read, a table
    without rows gives none. Texts of any length are handled whole.
    """
    spark, ranks_path = df.sparkSession, ranks_path or tokenizer_path()
    lexicon = build_lexicon(spark, ranks_path, frequent)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(ids, T.ArrayType(T.IntegerType(), True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, lexicon)
        for batch in batches:
            offsets, values = encoder.encode(batch.column(1))
            low = 0
            while low < batch.num_rows:  # the lists of one batch share 32-bit offsets
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + LIST_VALUES, side="right")) - 1)
                lists = pa.ListArray.from_arrays(pa.array((offsets[low : high + 1] - offsets[low]).astype(np.int32)), pa.array(values[offsets[low] : offsets[high]].astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], [id_col, ids])
                low = high

    return df.select(F.col(id_col), F.col(text).alias("__text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, n_tokens: str = "n_tokens", ranks_path: str | None = None, frequent: DataFrame | None = None) -> DataFrame:
    """The kept columns and n_tokens BIGINT, the number of ids of the row's text (0 for null and empty)."""
    spark, ranks_path = df.sparkSession, ranks_path or tokenizer_path()
    lexicon = build_lexicon(spark, ranks_path, frequent)
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, lexicon)
        for batch in batches:
            n = encoder.count(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, n_tokens])

    return df.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(run, schema)
