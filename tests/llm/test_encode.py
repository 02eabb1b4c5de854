"""Encoding: equal to the public tokenizer on any text, whatever the lexicon holds."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import encode as E
from panelwright.llm.arrays import run_hashes
from panelwright.llm.automaton import Transducer, minimal

tiktoken = pytest.importorskip("tiktoken")
RANKS = E.tokenizer_path()
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=E.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return E.Encoder(RANKS, Transducer.build(E.whole_words(RANKS)))


def lists(encoder, texts):
    offsets, values = encoder.encode(pa.array(texts, pa.string()))
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


CASES = [
    None, "", " ", "\n\n", "a", "it's they'll we've I'd 'sx x's's ''s 'S", " 's a 'll", "tab\t\ttab \n end  ", "\xa0\xa0x\xa0", "　漢字かな交じり文。", "12½ ² ٣", "é é ﬁ", "<|endoftext|>", "🙂🙂 👩‍👩‍👧", "x" * 5000, "ab " * 40000, "​", "a b\x85c",
]


def test_cases(encoder, reference):
    assert lists(encoder, CASES) == [reference.encode_ordinary(t or "") for t in CASES]
    assert encoder.count(pa.array(CASES, pa.string())).tolist() == [len(reference.encode_ordinary(t or "")) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.text(alphabet="ab'sdlvretm \n\xa0é1")), max_size=6))
def test_any_text(encoder, reference, texts):
    assert lists(encoder, texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_small_chunks_change_nothing(encoder, reference, monkeypatch):
    import panelwright.llm.arrays as arrays

    texts = [t for t in CASES if t is None or len(t) < 100] * 3
    monkeypatch.setattr(arrays.chunks, "__defaults__", (7,))
    assert lists(encoder, texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_own_merge_equals_the_compiled_one(reference):
    ranks = E.load_ranks(RANKS)
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode()
        assert E.merge_word(word, ranks) == reference._core_bpe.encode_single_piece(word)


def test_automaton_shares_suffixes_and_finds_all():
    words = sorted({b"stations", b"nations", b"ration", b"rations", b"nation", b"a", b"ab"})
    _, states = minimal(words)
    assert len(states) < sum(map(len, words)) / 1.5
    t = Transducer.build({w: [i, i + 100] for i, w in enumerate(words)})
    import numpy as np

    probe = [*words, b"station", b"natio", b"zz", b"abc"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    length = np.array([len(p) for p in probe])
    begin = np.cumsum(length) - length
    found = t.find(data, begin, length).tolist()
    assert found == [*range(len(words)), -1, -1, -1, -1]
    assert [t.pool[t.where[i] : t.where[i + 1]].tolist() for i in found[:2]] == [[0, 100], [1, 101]]


def test_saved_automaton(tmp_path):
    t = Transducer.build({b"ab": [1], b"b": [2, 3]})
    t.save(str(tmp_path / "x"))
    u = Transducer.map(str(tmp_path / "x"))
    assert u.pool.tolist() == [1, 2, 3] and u.longest == 2
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes(b"0" * 80)
        Transducer.map(str(tmp_path / "y"))


def test_run_hashes_depend_on_content_only():
    import numpy as np

    h = run_hashes(np.frombuffer(b"abcXabcYab", np.uint8), np.array([0, 4, 8]), np.array([3, 7, 10]))
    assert h[0] == h[1] != h[2]


def test_run_hashes_in_stretches():
    import numpy as np

    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, 3000)
    begin = np.sort(rng.choice(2900, 400, replace=False))
    end = np.minimum(begin + rng.integers(0, 60, 400), np.append(begin[1:], 3000))
    whole = run_hashes(values, begin, end)
    assert (whole == run_hashes(values, begin, end, 10)).all() and (whole == run_hashes(values, begin, end, 777)).all()


def test_corpus(spark, reference):
    rows = [(1, "It's here.", "x"), (2, None, None), (3, "", "y"), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in E.encode_corpus(df).collect())
    assert got == [(1, reference.encode_ordinary("It's here.")), (2, []), (3, []), (3, [])]
    assert E.encode_corpus(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in E.count_tokens(df, keep=["doc_id"]).orderBy("doc_id").collect()] == [4, 0, 0, 0]


def test_frequent_words_change_no_id(spark, reference):
    df = spark.createDataFrame([(i, f"Zarblex counts {i} Zarblexes") for i in range(20)], "doc_id long, text string")
    counts = E.word_counts(df)
    assert {bytes(r["word"]): r["count"] for r in counts.collect()}[b"Zarblex"] == 20
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(df, frequent=counts).collect()}
    assert got == {i: reference.encode_ordinary(f"Zarblex counts {i} Zarblexes") for i in range(20)}


def test_lexicon_without_a_mounted_folder(spark, reference, monkeypatch):
    monkeypatch.setattr(E, "local_path", lambda uri: None)
    lexicon = E.build_lexicon(spark, RANKS)
    assert not any(isinstance(p, str) for p in lexicon.parts)
    assert lists(E.Encoder(RANKS, lexicon.open()), ["It's a station."]) == [reference.encode_ordinary("It's a station.")]


def test_counts_of_unknown_words(spark, reference):
    """Without the words that are one id, counts are those of all words but them."""
    df = spark.createDataFrame([(1, "the the zorblax zorblax"), (2, None), (3, ""), (4, " zorblax the " + "q" * 80)], "doc_id long, text string")
    every = {r["word"]: r["count"] for r in E.word_counts(df).collect()}
    some = {r["word"]: r["count"] for r in E.word_counts(df, known=False).collect()}
    assert every[b" zorblax"] == some[b" zorblax"] == 3 and some == {w: n for w, n in every.items() if w in some}
    assert b" the" not in some and not any(len(w) > 64 for w in some)
