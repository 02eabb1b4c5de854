"""Language of documents and of passages within them.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-leader with an
elastic-net penalty and calibrated by a temperature. n-grams of one to three characters are taken within words; a text's
vector is its n-gram counts times inverse document frequency, over the root of their number. So a text's score is a sum
over its words, and a worker scores each distinct word of a batch once.

Training uses a bounded sample of labelled documents, as documented at SAMPLE_DOCUMENTS; everything else covers all texts.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.arrays import LETTER, Chunk, chunks, class_table, lower_table, mix64, ragged_index, run_hashes
from panelwright.session import local_path, shared_dir

#: Documents that the classifier is fitted on: half of them the same number for each label, half by frequency. A label
#: gets LABEL_DOCUMENTS of its documents at least (all if it has fewer), so with over 20 labels the sample grows with them.
SAMPLE_DOCUMENTS, LABEL_DOCUMENTS = 2400, 60
#: Documents from which a label that is no code of a language counts as one; with fewer it is taken for a typing error.
LEAST_DOCUMENTS = 20
#: Hashed features.
FEATURES = 1 << 17
#: Letters times labels whose n-grams are scored at once.
SCRATCH = 1_800_000
#: Consecutive sentences that make a passage.
PASSAGE = 3
#: Letters from which a piece of text counts as a sentence of a passage, ideographs and kana counting three each.
SENTENCE_LETTERS = 12
#: Cost of a change of language between sentences and bound of a sentence's evidence, in natural logarithms.
CHANGE, EVIDENCE = 5.0, 12.0

# Three-letter codes (ISO 639-2, both forms) and their two-letter codes.
THREE_LETTER = {
    "ara": "ar", "bul": "bg", "cat": "ca", "ces": "cs", "cze": "cs", "chi": "zh", "zho": "zh", "dan": "da", "deu": "de", "ger": "de", "dut": "nl", "nld": "nl",
    "ell": "el", "gre": "el", "eng": "en", "est": "et", "fin": "fi", "fra": "fr", "fre": "fr", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id",
    "isl": "is", "ice": "is", "ita": "it", "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt", "nor": "no", "nob": "nb", "pol": "pl", "por": "pt", "ron": "ro",
    "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "srp": "sr", "swe": "sv", "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi",
}

# Two-letter codes of languages (ISO 639-1, with the former iw, ji and sh). No number of documents is too small for them.
TWO_LETTER = """
    aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl
    gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu iw ja ji jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh
    mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr ss st su
    sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
""".split()


def label_code(c: Column) -> Column:
    """Two-letter code of a label in any spelling (case, region, three letters); null for null, blank and ``und``."""
    first = F.regexp_extract(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"^([a-z]+)", 1)
    table = F.create_map(*(F.lit(x) for pair in THREE_LETTER.items() for x in pair))
    # A code as it should be, the usual case, needs no pattern.
    return F.when(c.isin(TWO_LETTER), c).when((first != "") & (first != "und"), F.coalesce(F.try_element_at(table, first), first))


@dataclasses.dataclass
class Words:
    """Words and sentences of a chunk: where words begin and end, their sentence, and each sentence's text."""

    begin: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    span: np.ndarray


def sentences(chunk: Chunk, code: np.ndarray) -> Words:
    """Letter runs of a chunk by sentence. A sentence ends with the text, after an ideographic full stop, exclamation or
    question mark, and after . ! ? where white space follows; closing quotes and brackets go with it."""
    kind = class_table()[code]
    n = len(code)
    edge = np.zeros(n + 1, bool)
    edge[chunk.start] = True
    letter = kind == LETTER
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:n]
    begin = np.flatnonzero(letter & ~before)
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
    end = np.flatnonzero(letter & ~after) + 1
    closing = np.isin(code, np.array([ord(c) for c in "\"')]»”’」』）"], code.dtype))
    stop = np.isin(code, np.array([ord(c) for c in ".!?"], code.dtype))
    wide = np.isin(code, np.array([ord(c) for c in "。！？"], code.dtype))
    space = np.concatenate([kind[1:] == 3, [True]]) | edge[1:]
    quoted = np.concatenate([closing[1:], [False]])
    space2 = np.concatenate([space[1:], [True]])
    ends = wide | (stop & space) | (stop & quoted & space2)
    first = edge[:n].copy()
    first[1:] |= ends[:-1]
    number = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return Words(begin, end, number[begin] if len(begin) else np.zeros(0, np.int64), chunk.text_of(starts), np.append(starts, n))


def grams(code: np.ndarray, begin: np.ndarray, end: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, word by word, and how many each word has. A word's edges are characters of their own."""
    size = end - begin + 2
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), 1, np.uint64)
    inner = ragged_index(at + 1, end - begin)
    text[inner] = code[ragged_index(begin, end - begin)]
    last = np.zeros(len(text), bool)
    last[at + size - 1] = True
    text[at + size - 1] = 2
    none = np.uint64(0)
    one = np.concatenate([text[1:], [none]])
    two = np.concatenate([one[1:], [none]])
    stop1 = last
    stop2 = last | np.concatenate([last[1:], [True]])
    with np.errstate(over="ignore"):
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        uni, bi = text * a, text * a + one * b + np.uint64(1)
        tri = bi + two * c + np.uint64(1)
    table = np.stack([uni, bi, tri], 1)
    valid = np.stack([np.ones(len(text), bool), ~stop1, ~stop2], 1)
    index = (mix64(table[valid]) & np.uint64(features - 1)).astype(np.int64)
    return index, np.add.reduceat(valid.sum(1), at)


@dataclasses.dataclass
class Model:
    """Languages, weights times inverse document frequency (features x languages) and temperature."""

    labels: list[str]
    weights: np.ndarray
    temperature: float

    def word_scores(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the distinct words, n-grams of each, and the distinct word of each word."""
        _, first, word = np.unique(run_hashes(code, begin, end), return_index=True, return_inverse=True)
        k = len(self.labels)
        scores, counts = np.zeros((len(first), k), np.float32), np.zeros(len(first), np.int64)
        step = 0
        lengths = np.cumsum(end[first] - begin[first])
        while step < len(first):  # bounded scratch memory, also for very long words
            stop = max(step + 1, int(np.searchsorted(lengths, (lengths[step - 1] if step else 0) + SCRATCH // k, side="right")))
            index, n = grams(code, begin[first[step:stop]], end[first[step:stop]], len(self.weights))
            scores[step:stop] = np.add.reduceat(self.weights[index], np.cumsum(n) - n, axis=0)
            counts[step:stop] = n
            step = stop
        return scores, counts, word

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from sums of word scores and numbers of n-grams."""
        x = sums / np.sqrt(np.maximum(counts, 1))[:, None] / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def _sum_by(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by ascending group number."""
    out = np.zeros((groups, values.shape[1]), np.float64)
    if len(group):
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[at]] = np.add.reduceat(values, at, axis=0)
    return out


class Trainer:
    """Follow-the-regularised-leader (proximal, per coordinate) for multinomial logistic regression."""

    def __init__(self, features: int, labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001):
        self.z, self.n = np.zeros((features, labels), np.float32), np.zeros((features, labels), np.float32)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, np.float32(0), w)

    def step(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray, label: np.ndarray) -> None:
        """One batch: features and values of its examples one after the other, their number of features and their labels."""
        order = np.argsort(index.astype(np.int32), kind="stable")
        ranked = index[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        edges = np.flatnonzero(new)
        used = ranked[edges]
        at = np.empty(len(index), np.int64)
        at[order] = np.cumsum(new) - 1
        w = self.weights(used)
        starts = np.cumsum(counts) - counts
        x = np.add.reduceat(w[at] * value[:, None], starts, axis=0)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        g = (x / x.sum(axis=1, keepdims=True)).astype(np.float32)
        g[np.arange(len(label)), label] -= 1
        per = np.repeat(g, counts, axis=0)[order] * value[order, None]
        grad = np.add.reduceat(per, edges, axis=0)
        n = self.n[used]
        root = np.sqrt(n)
        sigma = (np.sqrt(n + grad * grad) - root) / self.alpha
        self.z[used] += grad - sigma * w
        self.n[used] = n + grad * grad


def train(texts: list[str], labels: list[str], features: int = FEATURES, epochs: int = 1, seed: int = 1) -> Model:
    """Model of the labels from labelled texts, whose sentences are the examples.

    Labels may be wrong and texts mixed. So training starts again without the texts that as a whole are taken for another
    language than their label, and once more without sentences that surely are in another one. A tenth of the texts isn't trained on and sets the temperature,
    but labels with few texts keep them all for training.
    """
    names = sorted(set(labels))
    if not names:
        return Model(["und"], np.zeros((features, 1), np.float32), 1.0)
    number = {x: i for i, x in enumerate(names)}
    index, counts, label, text = [], [], [], []
    for low, chunk in chunks(pa.array(texts, pa.string())):
        code = lower_table()[chunk.code]
        words = sentences(chunk, code)
        if not len(words.begin):
            continue
        found, n = grams(code, words.begin, words.end, features)
        held, first = np.unique(words.sentence, return_index=True)
        index.append(found)
        counts.append(np.add.reduceat(n, first))
        text.append(words.text[held] + low)
    if not index:
        return Model(names, np.zeros((features, len(names)), np.float32), 1.0)
    index, counts, text = np.concatenate(index), np.concatenate(counts), np.concatenate(text)
    label = np.array([number[labels[i]] for i in text])
    # An n-gram of an example becomes one feature with its count.
    whole_counts = counts
    key = np.sort(np.repeat(np.arange(len(counts), dtype=np.int64), counts) * features + index)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    example, index = key[first] // features, key[first] % features
    counts = np.bincount(example, minlength=len(counts))
    starts = np.cumsum(counts) - counts
    idf = (1 + np.log((1 + len(counts)) / (1 + np.bincount(index, minlength=features)))).astype(np.float32)
    value = (times * idf[index] / np.sqrt(whole_counts)[example]).astype(np.float32)
    rng = np.random.default_rng(seed)
    of_label = np.array([number[x] for x in labels])
    held_out = (rng.random(len(texts)) < 0.1) & (np.bincount(of_label)[of_label] >= LEAST_DOCUMENTS)
    kept = ~held_out[text]

    def scores(weights: np.ndarray) -> np.ndarray:
        out = np.empty((len(counts), len(names)))
        some = max(1, 18_000 // len(names))  # bounded scratch memory, whatever the number of labels
        for low in range(0, len(counts), some):
            high = min(len(counts), low + some)
            part = slice(starts[low], starts[high - 1] + counts[high - 1])
            out[low:high] = np.add.reduceat(weights[index[part]] * value[part, None], starts[low:high] - starts[low], axis=0)
        return out

    cleaned = False
    for last in (False, False, True):
        trainer = Trainer(features, len(names))
        rows = np.flatnonzero(kept)
        for _ in range(epochs):
            rng.shuffle(rows)
            for low in range(0, len(rows), 64):
                batch = rows[low : low + 64]
                at = ragged_index(starts[batch], counts[batch])
                trainer.step(index[at], value[at], counts[batch], label[batch])
        weights = trainer.weights()
        x = scores(weights)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        whole = np.zeros((len(texts), len(names)))
        np.add.at(whole, text, x * np.sqrt(whole_counts)[:, None])
        agrees = whole.argmax(1)[text] == label
        # The second time single sentences go as well, those of passages in another language.
        if not last:
            kept = ~held_out[text] & agrees & ~(cleaned & (p.argmax(1) != label) & (p.max(1) > 0.95))
            cleaned = True
    test = held_out[text] & agrees
    temperature = 1.0
    if test.any():
        x, y = x[test], label[test]

        def loss(t: float) -> float:
            s = x / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        low, high = math.log(0.5), math.log(20)
        ratio = (math.sqrt(5) - 1) / 2
        for _ in range(40):  # golden section
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(math.exp(a)) <= loss(math.exp(b)) else (a, high)
        temperature = math.exp((low + high) / 2)
    return Model(names, (weights * idf[:, None]).astype(np.float32), temperature)


def _stored(spark: SparkSession, texts: list[str], labels: list[str]) -> Model:
    """The model of this sample: read from the shared folder where it has been trained before, else trained and stored."""
    digest = hashlib.sha256(repr((FEATURES, sorted(set(labels)))).encode())
    for pair in zip(labels, texts):
        digest.update("\0".join(pair).encode("utf-8", "surrogatepass") + b"\1")
    path = local_path(f"{shared_dir(spark)}/languages-{digest.hexdigest()[:24]}.npz")
    if path and os.path.exists(path):
        with np.load(path) as kept:
            return Model(kept["labels"].tolist(), kept["weights"], float(kept["temperature"]))
    model = train(texts, labels)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        partial = f"{path}.{uuid.uuid4().hex}.npz"
        np.savez(partial, labels=np.array(model.labels), weights=model.weights, temperature=model.temperature)
        os.replace(partial, path)
    return model


def fit(df: DataFrame, text: str, label: str, id_col: str, documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Trains on about documents rows of all labels, chosen by the hash of their id, and LABEL_DOCUMENTS of each label at least.

    Of a smaller table all rows are used. Labels are read by label_code; rows without one or without a letter aren't trained
    on, nor are those with a label that is neither a code of a language nor on LEAST_DOCUMENTS rows. A model is kept in the
    shared folder under the content of its sample.
    """
    spellings = df.groupBy(F.col(label).alias("l")).count()  # reads the labels only
    counts = spellings.groupBy(label_code(F.col("l")).alias("l")).agg(F.sum("count").alias("count")).filter(F.col("l").isNotNull() & (F.col("l").isin(TWO_LETTER) | (F.col("count") >= LEAST_DOCUMENTS))).orderBy(F.desc("count"), "l").collect()
    if not counts:
        return train([], [])
    total = sum(r["count"] for r in counts)
    quota = {r["l"]: max(min(LABEL_DOCUMENTS, documents), int(documents / 2 / len(counts) + documents / 2 * r["count"] / total)) for r in counts}
    bounds = []
    for r in counts:
        # The hash is uniform, so this share of its range holds a little over the quota.
        share = min(1.0, 1.2 * quota[r["l"]] / r["count"])
        bounds += [F.lit(r["l"]), F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)]
    rows = df.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l"), F.xxhash64(F.col(id_col), F.lit(17)).alias("h"))
    chosen = F.col("h") <= F.try_element_at(F.create_map(*bounds), F.col("l"))
    kept: dict[str, list[str]] = {}
    sample = rows.filter(chosen).filter(F.col("t").rlike(r"\p{L}")).select("l", "t", "h").toArrow().sort_by([("l", "ascending"), ("h", "ascending")])
    for name, body in zip(sample.column("l").to_pylist(), sample.column("t").to_pylist()):
        if len(kept.setdefault(name, [])) < quota[name]:
            kept[name].append(body)
    return _stored(df.sparkSession, [t for texts in kept.values() for t in texts], [name for name, texts in kept.items() for _ in texts])


def smooth(logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Most likely languages of consecutive sentences when a change costs CHANGE. weight 0 leaves a sentence without a say."""
    best, back = logs[0] * weight[0], []
    for row, w in zip(logs[1:], weight[1:]):
        top = int(best.argmax())
        stay = best >= best[top] - CHANGE
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - CHANGE) + row * w
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


_PASSAGE_TYPE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sentences", T.IntegerType())])


def _passages(model: Model, column: pa.Array) -> Iterator[tuple]:
    """Per text: own language or None, confidence, and its passages as (lang, confidence, begin, end, sentences)."""
    labels = np.array(model.labels, object)
    for _, chunk in chunks(column):
        code = lower_table()[chunk.code]
        words = sentences(chunk, code)
        if not len(words.begin):
            yield from ((None, None, []) for _ in range(chunk.texts))
            continue
        scores, grams_of, word = model.word_scores(code, words.begin, words.end)
        n = len(words.text)
        sums = _sum_by(scores[word], words.sentence, n)
        count = np.bincount(words.sentence, grams_of[word], n)
        length = (words.end - words.begin).astype(np.float64)
        length[code[words.begin] >= 0x3040] *= 3
        letters = np.bincount(words.sentence, length, n)
        p = model.probabilities(sums, count)
        logs = np.maximum(np.log(np.maximum(p, 1e-30)), -EVIDENCE)
        whole = model.probabilities(_sum_by(sums, words.text, chunk.texts), np.bincount(words.text, count, chunk.texts))
        full = letters >= SENTENCE_LETTERS
        guess = p.argmax(1)
        first = np.searchsorted(words.text, np.arange(chunk.texts + 1))
        said = np.bincount(words.text, letters, chunk.texts)
        # Texts in which all sentences agree need no smoothing.
        own = whole.argmax(1)
        other = np.bincount(words.text, full & (guess != own[words.text]), chunk.texts)
        for i in range(chunk.texts):
            if not said[i]:
                yield None, None, []
                continue
            low, high = first[i], first[i + 1]
            if not other[i]:
                yield labels[own[i]], float(whole[i, own[i]]), [(labels[own[i]], float(whole[i, own[i]]), 0, int(chunk.start[i + 1] - chunk.start[i]), int(full[low:high].sum()))]
                continue
            path = smooth(logs[low:high], np.where(full[low:high], 1.0, 0.25))
            edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
            runs = []
            for a, b in zip(edges, edges[1:]):
                k = path[a]
                weight = np.maximum(letters[low + a : low + b], 1e-9)
                runs.append((labels[k], float((p[low + a : low + b, k] * weight).sum() / weight.sum()), int(words.span[low + a] - chunk.start[i]), int(words.span[low + b] - chunk.start[i]), int(full[low + a : low + b].sum())))
            size: dict[str, float] = {}
            for a, b in zip(edges, edges[1:]):
                size[labels[path[a]]] = size.get(labels[path[a]], 0.0) + letters[low + a : low + b].sum()
            main = max(size, key=lambda x: (size[x], x))
            yield main, float(whole[i, model.labels.index(main)]) if len(size) == 1 else max(r[1] for r in runs if r[0] == main), runs


def identify(df: DataFrame, id_col: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """(id_col, label, lang, confidence, issue, passages) of every row.

    lang is the language with most letters, confidence its calibrated probability; passages are consecutive sentences of
    one language with begin, end (characters), number of sentences and confidence. issue: ``mixed`` if at least two
    languages have a passage of three or more sentences, else ``missing`` (label null, blank or und), ``wrong`` (label of
    another language) or null. Null, empty and wordless texts have a null lang, no passages and no issue. Repeated rows
    stay repeated, other columns aren't read, an empty table gives an empty result. Without model one is fitted.
    """
    model = model or fit(df, text, label, id_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x labels floats
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("label", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("passages", T.ArrayType(_PASSAGE_TYPE))])
    passage_type = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("begin", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sure, found = [], [], []
            for lang, confidence, runs in _passages(shared.value, batch.column(2)):
                langs.append(lang)
                sure.append(confidence)
                found.append([dict(zip(("lang", "confidence", "begin", "end", "sentences"), r)) for r in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(found, passage_type)], schema.names)

    rows = df.select(F.col(id_col).alias("id"), label_code(F.col(label)).alias("label"), F.col(text).alias("text")).mapInArrow(run, schema)
    long = F.array_distinct(F.transform(F.filter("passages", lambda x: x["sentences"] >= PASSAGE), lambda x: x["lang"]))
    issue = F.when(F.col("lang").isNull(), None).when(F.size(long) >= 2, "mixed").when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("lang"), "wrong")
    return rows.select(F.col("id").alias(id_col), "label", "lang", "confidence", issue.alias("issue"), "passages")


def issues(found: DataFrame, id_col: str) -> DataFrame:
    """(id_col, issue, lang): one row per document with an issue, of a mixed one a row per language of a long passage."""
    long = F.array_distinct(F.transform(F.filter("passages", lambda x: x["sentences"] >= PASSAGE), lambda x: x["lang"]))
    langs = F.when(F.col("issue") == "mixed", long).otherwise(F.array("lang"))
    return found.filter("issue is not null").select(id_col, "issue", F.explode(langs).alias("lang"))
