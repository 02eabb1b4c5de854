"""Near-duplicate texts by anchor-point covering.

A text's fingerprint is 128 bits: of each of 128 min-hashes of its word set one bit. Texts of similarity J differ in about
(1 - J) / 2 of the bits. Eight tables take 23 bits each; the 4096 words of the perfect binary Golay code are a table's
anchors. They cover all 23-bit strings within radius 3, so each fingerprint has exactly one home anchor, and it is
replicated to every anchor within radius plus threshold (3 + 1, about 5.3 anchors). Two fingerprints that differ in at most
one bit of a table therefore always meet at the home of either, others often do; over eight tables pairs of J = 0.75 meet
with a chance of 0.992, of 0.8 with 0.998, of 0.9 with 1.000 (simulated). At each anchor homes are compared with all
fingerprints there; what is near enough is checked exactly on the word sets, so no false pair comes out.

Large collections lengthen the code: e further bits, each its own code, make 2 ** e times as many anchors, and more tables
(TABLES) keep the chance at J = 0.75 above 0.99. Texts with one word set are one class, handled once. Crowded anchors are
told by cells, a number of anchors each, of which there are at most CELLS however large the collection is; those of a
crowded cell are split into blocks that meet pairwise, each in a group of its own. A pair is reported at one canonical
anchor only, so pairs needn't be made distinct by a shuffle.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.arrays import chunks, lower_table, mix64, run_hashes
from panelwright.session import buckets_for, cut, discard, partitions_for

BITS = 128
RADIUS = 3
THRESHOLD = 1
GOLAY = 0b101011100011  # generator polynomial of the [23, 12, 7] code
#: Tables by pairs of further bits.
TABLES = (8, 12, 16, 24, 34, 46, 66)
#: Fingerprints of one anchor compared in one group; the anchors of a cell with more, and with CROWDED times the mean, are split into blocks.
ANCHOR_LIMIT, CROWDED = 20_000, 4
#: Cells of anchors whose fingerprints are counted. At most CELLS / CROWDED of them are crowded, which bounds what the driver gets and sends.
CELLS = 1 << 22
#: Room for block numbers of a split anchor. Blocks grow where it is used up.
BLOCK_BITS = 14
#: Replicas that a bucket of anchors should hold.
BUCKET_REPLICAS = 1_500_000


def word_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk: the first text's index, the number of distinct words of each text, and their hashes text by text.

    Words are the runs of a-z and 0-9 of the text in lower case.
    """
    for low, chunk in chunks(column):
        code = lower_table()[chunk.code]
        dotted = np.flatnonzero(code == 0x130)  # its lower case is an i and a dot
        code[dotted] = ord("i")
        alnum = ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57))
        edge = np.zeros(len(code) + 1, bool)
        edge[chunk.start] = True
        edge[dotted + 1] = True
        edge = edge[: len(code)]
        before = np.concatenate([[False], alnum[:-1]])
        begin = np.flatnonzero(alnum & (~before | edge))
        after = np.concatenate([alnum[1:] & ~edge[1:], [False]])
        end = np.flatnonzero(alnum & ~after) + 1
        hashes, text = run_hashes(code, begin, end), chunk.text_of(begin)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield low, np.bincount(text[new], minlength=chunk.texts), hashes[new]


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, BITS, dtype=np.uint32)


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, 16) bytes: one bit of each min-hash of the sets that begin at starts (none empty)."""
    halves = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    times, plus = _multipliers()
    bits = np.empty((len(starts), BITS), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(BITS):
            least = np.minimum.reduceat(halves[k & 1] * times[k] + plus[k], starts)
            bits[:, k] = (least ^ (least >> np.uint32(5)) ^ (least >> np.uint32(11))) & np.uint32(1)
    return np.packbits(bits, axis=1)


@functools.cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 11 and lower 12 bits, and of each syndrome the error of a home, the errors up to weight
    RADIUS + THRESHOLD (padded with -1) and how many of them have at most weight RADIUS + THRESHOLD - 1."""

    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    single = [syndrome(1 << i) for i in range(23)]
    coset: list[list[int]] = [[] for _ in range(2048)]
    near = np.zeros(2048, np.int64)
    for weight in range(RADIUS + THRESHOLD + 1):
        for places in itertools.combinations(range(23), weight):
            s = functools.reduce(lambda a, i: a ^ single[i], places, 0)
            coset[s].append(sum(1 << i for i in places))
            near[s] += weight < RADIUS + THRESHOLD
    width = max(map(len, coset))
    errors = np.full((2048, width), -1, np.int64)
    for s, found in enumerate(coset):
        errors[s, : len(found)] = found
    upper = np.array([syndrome(i << 12) for i in range(2048)], np.int64)
    lower = np.array([syndrome(i) for i in range(4096)], np.int64)
    return upper, lower, errors[:, 0].copy(), errors, near


def shape(rows: int) -> tuple[int, int]:
    """Tables and further bits for a collection: a longer code once 4096 anchors would hold too many rows each."""
    extra = 2 * min(len(TABLES) - 1, max(0, ((max(1, rows) - 1).bit_length() - 21 + 2) // 3))
    return TABLES[extra // 2], extra


def cell_of(anchors: np.ndarray) -> np.ndarray:
    """Cell of each anchor, itself where there are few."""
    return np.where(anchors < CELLS, anchors, (mix64(anchors.astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64))


@functools.cache
def _places(tables: int, extra: int) -> np.ndarray:
    rng = np.random.default_rng(7919)
    rows, deck = [], []
    for _ in range(tables):
        taken: list[int] = []
        while len(taken) < 23 + extra:
            if not deck:  # every bit is used once before any is used again
                deck = rng.permutation(BITS).tolist()
            at = next((i for i, bit in enumerate(deck) if bit not in taken), None)
            if at is None:
                deck = []
            else:
                taken.append(deck.pop(at))
        rows.append(taken)
    return np.array(rows)


class Code:
    """The anchors of all tables; an anchor's number is table, extra bits and the 12 leading bits of its Golay word."""

    def __init__(self, tables: int, extra: int):
        self.tables, self.extra = tables, extra
        self.places = _places(tables, extra)

    def read(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) Golay parts and further bits of the fingerprints."""
        bits = np.unpackbits(prints, axis=1)
        powers = 1 << np.arange(23)
        golay = np.stack([bits[:, p[:23]].astype(np.int64) @ powers for p in self.places], 1)
        more = 1 << np.arange(self.extra)
        rest = np.stack([bits[:, p[23:]].astype(np.int64) @ more if self.extra else np.zeros(len(bits), np.int64) for p in self.places], 1)
        return golay, rest

    @staticmethod
    def syndrome(golay: np.ndarray) -> np.ndarray:
        upper, lower, *_ = code_tables()
        return upper[golay >> 12] ^ lower[golay & 4095]

    def homes(self, golay: np.ndarray) -> np.ndarray:
        return golay ^ code_tables()[2][self.syndrome(golay)]

    def number(self, table, word, rest):
        return (table << (12 + self.extra)) | (rest << 12) | (word >> 11)

    def replicas(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor number and whether the anchor is the row's home, for every anchor within radius plus threshold."""
        golay, rest = self.read(prints)
        _, _, _, errors, near = code_tables()
        rows, anchors, home = [], [], []
        for t in range(self.tables):
            g, x = golay[:, t], rest[:, t]
            s = self.syndrome(g)
            e = errors[s]
            row, column = np.nonzero(e >= 0)
            rows.append(row)
            anchors.append(self.number(t, g[row] ^ e[row, column], x[row]))
            home.append(column == 0)
            for b in range(self.extra):  # one of the further bits flipped, the Golay part one nearer
                row, column = np.nonzero((e >= 0) & (np.arange(e.shape[1]) < near[s][:, None]))
                rows.append(row)
                anchors.append(self.number(t, g[row] ^ e[row, column], x[row] ^ (1 << b)))
                home.append(np.zeros(len(row), bool))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)

    def first_meeting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the first anchor at which each pair of fingerprints meets: of the first table in which they meet the
        home of the left one if the right one is replicated there, else that of the right one. -1: nowhere."""
        gl, xl = self.read(left)
        gr, xr = self.read(right)
        hl, hr = self.homes(gl), self.homes(gr)
        apart = np.bitwise_count(xl ^ xr).astype(np.int64)
        reach = RADIUS + THRESHOLD - apart
        near = apart <= THRESHOLD
        at_left, at_right = near & (np.bitwise_count(gr ^ hl) <= reach), near & (np.bitwise_count(gl ^ hr) <= reach)
        meets = at_left | at_right
        table = meets.argmax(1)
        pick = np.arange(len(gl)), table
        word = np.where(at_left[pick], hl[pick], hr[pick])
        rest = np.where(at_left[pick], xl[pick], xr[pick])
        return np.where(meets.any(1), self.number(table, word, rest), -1)


def _split(crowded: tuple[np.ndarray, np.ndarray], rows: np.ndarray, anchors: np.ndarray, home: np.ndarray, ids: np.ndarray):
    """Adds to the records of crowded cells (ascending, with their number of blocks) the pair of blocks in which they are
    compared; others have the pair 0, 0."""
    cells, blocks = crowded
    if not len(cells):
        zero = np.zeros(len(rows), np.int64)
        return rows, anchors, home, zero, zero, zero
    cell = cell_of(anchors)
    at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    parts = np.where(cells[at] == cell, blocks[at], 1)
    own = (mix64(ids.astype(np.uint64))[rows] % parts.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(rows)), parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = own[again]
    return rows[again], anchors[again], home[again], mine, np.minimum(mine, other), np.maximum(mine, other)


def _compare(prints: np.ndarray, sizes: np.ndarray, key: np.ndarray, doc: np.ndarray, home: np.ndarray, side: np.ndarray, limit: int, similarity: float) -> tuple[np.ndarray, ...]:
    """Pairs of documents within limit bits at each key: (left, right, key, sides), left always at home there.

    The members of a key are in order of their set's size, so that a block of homes meets only those whose size allows the
    similarity.
    """
    order = np.lexsort((sizes[doc], key))
    key, doc, home, side = key[order], doc[order], home[order], side[order]
    cut_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(cut_at[1:], len(key))
    homes = np.add.reduceat(home.astype(np.int64), cut_at)
    words, size = prints.view(np.uint64)[doc], sizes[doc]
    one, two = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    busy = np.flatnonzero((homes > 0) & (ends - cut_at > 1))
    out = []
    for begin, end in zip(cut_at[busy].tolist(), ends[busy].tolist()):
        at_home = begin + np.flatnonzero(home[begin:end])
        step = max(1, min(64, 500_000 // (end - begin)))
        for k in range(0, len(at_home), step):
            some = at_home[k : k + step]
            low = begin + int(np.searchsorted(size[begin:end], size[some[0]] * similarity - 1e-9))
            high = begin + int(np.searchsorted(size[begin:end], size[some[-1]] / similarity + 1e-9, side="right"))
            far = np.bitwise_count(one[some, None] ^ one[None, low:high])
            far += np.bitwise_count(two[some, None] ^ two[None, low:high])
            hit = np.flatnonzero(far.ravel() <= limit)
            i, j = some[hit // (high - low)], low + hit % (high - low)
            # Of two homes each pair counts once.
            good = (i < j) | ((i != j) & ~home[j])
            if good.any():
                i, j = i[good], j[good]
                out.append((doc[i], doc[j], key[i], side[i], side[j]))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out))


def text_sets(texts: DataFrame, id_col: str, text: str, least_words: int = 8) -> DataFrame:
    """(id, n, k1, k2, f1, f2, words): size, 128-bit key, fingerprint and 32-bit word hashes of every text's word set.

    Texts of fewer than least_words distinct words, null ones included, are left out.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("k1", "k2", "f1", "f2")), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, counts, hashes in word_sets(batch.column(1)):
                kept = np.flatnonzero(counts >= max(1, least_words))
                if not len(kept):
                    continue
                inside = np.repeat(counts >= max(1, least_words), counts)
                hashes, counts = hashes[inside], counts[kept]
                starts = np.cumsum(counts) - counts
                with np.errstate(over="ignore"):
                    keys = [np.add.reduceat(h, starts).view(np.int64) for h in (hashes, mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)))]
                prints = fingerprints(hashes, starts).view(np.int64)
                short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(hashes)).astype(np.int32)), pa.array(short))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept + low)), pa.array(counts.astype(np.int32)), *(pa.array(k) for k in keys), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists], schema.names)

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Near:
    """What near_duplicates found, as DataFrames over tables written to the shared folder.

    pairs: (a, b) of class representatives, a < b. members: (id, rep, copies), every text that took part.
    """

    def __init__(self, pairs: DataFrame, members: DataFrame):
        self.pairs, self.members = pairs, members

    def all_pairs(self, id_a: str = "id_a", id_b: str = "id_b") -> DataFrame:
        """Every pair of related texts, copies expanded, id_a < id_b."""
        copies = self.members.filter("copies > 1")
        x, y = copies.select("rep", F.col("id").alias("x")), copies.select("rep", F.col("id").alias("y"))
        same = x.join(y, "rep").filter("x < y").select("x", "y")
        x, y = self.members.select(F.col("rep").alias("a"), F.col("id").alias("x")), self.members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        other = self.pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return same.unionByName(other).select(F.col("x").alias(id_a), F.col("y").alias(id_b))

    def per_text(self, id_col: str = "id") -> DataFrame:
        """(id, class_id, copies, links): class of each text and with how many other classes it is linked."""
        ends = self.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        return self.members.join(ends, "rep", "left").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(texts: DataFrame, id_col: str, text: str, similarity: float = 0.75, least_words: int = 8, anchor_limit: int = ANCHOR_LIMIT) -> Near:
    """Texts whose word sets have a Jaccard similarity of at least similarity.

    id_col must be a unique whole number. Null, empty and short texts (fewer than least_words words) take part in nothing;
    texts with equal word sets are one class; very long texts are handled whole; an empty table gives empty results; other
    columns aren't read. Every reported pair is exact; a pair may be missed with the chances stated above.
    """
    spark = texts.sparkSession
    sets = cut(text_sets(texts, id_col, text, least_words), "sets")
    classes = sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("f1").alias("f1"), F.max("f2").alias("f2"), F.max("n").alias("n"))
    classes = cut(classes, "classes")
    members = sets.select("id", "k1", "k2").join(classes.select("k1", "k2", "rep", "copies"), ["k1", "k2"]).select("id", "rep", "copies")
    rows = classes.count()
    tables, extra = shape(rows)
    replicas = int(rows * tables * (5.33 + extra)) + 1
    # Comparing costs more than moving: a fixed number of partitions, which aren't merged for being small.
    parts = max(12, 2 * spark.sparkContext.defaultParallelism, partitions_for(spark, replicas, BUCKET_REPLICAS))
    buckets = 2 * max(parts, buckets_for(spark, replicas, BUCKET_REPLICAS))
    # Bits in which a pair may differ before the exact check: the mean at the threshold and four and a half deviations.
    apart = (1 - similarity) / 2
    limit = int(BITS * apart + 4.5 * (BITS * apart * (1 - apart)) ** 0.5)
    code = Code(tables, extra)
    wide = tables << (13 + extra) >= 1 << 32  # anchor numbers with the home bit need more than 32 bits
    prints_of = lambda batch: np.ascontiguousarray(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)).view(np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique(cell_of(code.replicas(prints_of(batch))[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    mean = replicas / min(CELLS, tables << (12 + extra))
    loads = classes.select("rep", "f1", "f2").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > max(anchor_limit, int(CROWDED * mean)))
    found = loads.toArrow().sort_by("cell")  # at most CELLS / CROWDED rows
    load, block = found.column("n").to_numpy(), max(anchor_limit, int(mean))
    crowded = spark.sparkContext.broadcast((found.column("cell").to_numpy(), np.minimum((1 << BLOCK_BITS) - 1, -(-2 * load // block))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, prints, size = batch.column(0).to_numpy(), prints_of(batch), batch.column(3).to_numpy()
            row, anchor, home, side, low, high = _split(crowded.value, *code.replicas(prints), ids)
            bucket = (mix64(((anchor.astype(np.uint64) << np.uint64(2 * BLOCK_BITS)) ^ (low << BLOCK_BITS ^ high).astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            out: list[list] = [[] for _ in range(8)]
            for begin, end in zip(edges.tolist(), edges[1:].tolist()):
                some = order[begin:end]
                b = int(bucket[some[0]])
                docs, local = np.unique(row[some], return_inverse=True)
                place = anchor[some].astype(np.int64) << 1 | home[some]
                split = np.stack([side[some], low[some], high[some]], 1).astype("<u2").tobytes() if len(crowded.value[0]) else b""
                record = (b, docs.size, ids[docs].tobytes(), prints[docs].tobytes(), size[docs].astype("<i4").tobytes(), place.astype("<i8" if wide else "<u4").tobytes(), local.astype("<u2" if docs.size <= 65536 else "<u4").tobytes(), split)
                for column, value in zip(out, record):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.int32() if k == 1 else pa.binary()) for k, x in enumerate(out)], schema.names)

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("docs", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("ids", "prints", "sizes", "places", "locals", "splits"))])

    def meet(table: pa.Table) -> pa.Table:
        ids, prints, sizes, places, docs, splits, seen = [], [], [], [], [], [], 0
        for r in table.to_batches():
            for n, i, p, z, a, d, s in zip(*(r.column(c).to_pylist() for c in schema.names[1:])):
                ids.append(np.frombuffer(i, np.int64))
                prints.append(np.frombuffer(p, np.uint8).reshape(-1, 16))
                sizes.append(np.frombuffer(z, "<i4"))
                places.append(np.frombuffer(a, "<i8" if wide else "<u4").astype(np.int64))
                docs.append(np.frombuffer(d, "<u2" if n <= 65536 else "<u4").astype(np.int64) + seen)
                splits.append(np.frombuffer(s, "<u2").reshape(-1, 3).astype(np.int64) if s else np.zeros((len(docs[-1]), 3), np.int64))
                seen += n
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not ids:
            return empty
        ids, prints, sizes, places, docs, splits = (np.concatenate(x) for x in (ids, prints, sizes, places, docs, splits))
        prints = np.ascontiguousarray(prints)
        anchor, home = places >> 1, (places & 1).astype(bool)
        key = anchor << 2 * BLOCK_BITS | splits[:, 1] << BLOCK_BITS | splits[:, 2]
        left, right, at, ls, rs = _compare(prints, sizes, key, docs, home, splits[:, 0], limit, similarity)
        if not len(left):
            return empty
        low, high = (at >> BLOCK_BITS) & ((1 << BLOCK_BITS) - 1), at & ((1 << BLOCK_BITS) - 1)
        good = (ids[left] != ids[right]) & ((low == high) | (ls != rs))
        left, right, at = left[good], right[good], at[good] >> 2 * BLOCK_BITS
        swap = ids[left] > ids[right]
        a, b = np.where(swap, right, left), np.where(swap, left, right)
        good = code.first_meeting(prints[a], prints[b]) == at if len(a) else np.zeros(0, bool)
        found = np.unique(np.stack([ids[a[good]], ids[b[good]]], 1), axis=0)
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    blobs = classes.select("rep", "f1", "f2", "n").mapInArrow(spread, schema)
    candidates = blobs.repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long")
    # Only representatives occur among the candidates: the words of copies stay where they are.
    words = sets.select("id", "n", "words").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    one, two = words.toDF("a", "na", "wa"), words.toDF("b", "nb", "wb")
    both = candidates.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    near = shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared) - F.lit(1e-9)
    result = Near(cut(both.filter(near).select("a", "b"), "pairs"), cut(members, "members"))
    discard(sets, classes)
    return result
