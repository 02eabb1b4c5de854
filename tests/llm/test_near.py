"""Near duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from panelwright.llm import near as N


def words(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def brute(rows, similarity=0.75, least=8):
    sets = [(i, words(t)) for i, t in rows]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return sorted((min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if len(a & b) >= similarity * len(a | b))


def family(rng, n_groups, copies, size=40):
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(rng.randint(1, copies)):
            one = list(base)
            for _ in range(rng.randint(0, 5)):
                one[rng.randrange(size)] = f"w{rng.randrange(4000)}"
            rng.shuffle(one)
            rows.append((len(rows), rng.choice([" ", "\n", "\xa0", ", "]).join(one).title()))
    return rows


def pairs(spark, rows, **options):
    near = N.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", **options)
    return near, sorted((r["id_a"], r["id_b"]) for r in near.all_pairs().collect())


@pytest.mark.parametrize("limit", [20_000, 12])
def test_all_pairs(spark, limit):
    """Also with anchors so crowded that they are split into blocks."""
    rows = family(random.Random(5), 60, 6) + [(1000 + i, "the same text of a great many words that is stored again and again for each firm") for i in range(30)]
    got = pairs(spark, rows, anchor_limit=limit)[1]
    want = brute(rows)
    assert len(want) > 400 and set(got) <= set(want) and len(got) == len(set(got))
    assert len(got) >= 0.99 * len(want)


def test_edges(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (2, text.upper() + "!"), (3, None), (4, ""), (5, "one two three"), (6, "... ---"), (7, text + " nine ten"), (8, text + " nine ten eleven"), (9, "漢字 " * 50)]
    near, got = pairs(spark, rows)
    assert got == brute(rows) and (1, 2) in got and (1, 7) in got and (1, 8) not in got
    per = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in near.per_text().collect()}
    assert per[2] == (1, 2, 1) and set(per) == {1, 2, 7, 8}


def test_very_long_text(spark):
    rng = random.Random(1)
    body = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(body)), (2, " ".join(reversed(body[1000:])))]
    assert pairs(spark, rows)[1] == [(1, 2)]


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "k long, t string, a int, n int, words string")
    assert N.near_duplicates(df, "k", "t").all_pairs().count() == 0
    full = spark.createDataFrame([(1, "a b c d e f g h", 1, None, "x"), (2, "a b c d e f g h", None, 2, None)], "k long, t string, a int, n int, words string")
    assert N.near_duplicates(full, "k", "t").all_pairs().collect() == [(1, 2)]


def test_code_covers_and_meets():
    """Every string has one home within the radius; fingerprints one bit apart per table always meet at one canonical anchor."""
    code = N.Code(8, 0)
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    golay, _ = code.read(prints)
    homes = code.homes(golay)
    assert (np.bitwise_count(golay ^ homes) <= N.RADIUS).all() and (code.syndrome(homes) == 0).all()
    row, _, home = code.replicas(prints)
    assert (np.bincount(row[home], minlength=500) == 8).all()
    other = prints.copy()
    other[:, 3] ^= 16
    assert (code.first_meeting(prints, other) >= 0).all()
    assert (code.first_meeting(prints, other) == code.first_meeting(other, prints)).mean() > 0.9


def test_longer_code_still_finds(spark, monkeypatch):
    monkeypatch.setattr(N, "shape", lambda rows: (12, 2))
    rows = family(random.Random(8), 50, 6)
    got, want = pairs(spark, rows)[1], brute(rows)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def test_shape_grows():
    assert N.shape(10) == (8, 0) and N.shape(1 << 21) == (8, 0) and N.shape(1 << 24)[1] == 2 and N.shape(1 << 27)[1] == 4


def recall(tables, extra, similarity, n=6000):
    """Share of simulated pairs of fingerprints at this similarity that meet at an anchor and pass the check of their bits."""
    rng = np.random.default_rng(tables)
    bits = rng.integers(0, 2, (n, N.BITS), dtype=np.uint8)
    apart = (1 - similarity) / 2
    flips = (rng.random((n, N.BITS)) < apart).astype(np.uint8)
    limit = int(N.BITS * apart + 4.5 * (N.BITS * apart * (1 - apart)) ** 0.5)
    meets = N.Code(tables, extra).first_meeting(np.packbits(bits, axis=1), np.packbits(bits ^ flips, axis=1)) >= 0
    return (meets & (flips.sum(1) <= limit)).mean()


@pytest.mark.parametrize("rows", [10**5, 3 * 10**6, 3 * 10**7, 10**8, 10**9, 10**10, 10**11])
def test_recall_of_every_shape(rows):
    assert recall(*N.shape(rows), 0.75) >= 0.99 - 0.003 and recall(*N.shape(rows), 0.8) >= 0.997


def test_crowded_cells_of_several_anchors(spark, monkeypatch):
    """Anchors that share a cell, as in large collections, are split together."""
    monkeypatch.setattr(N, "CELLS", 64)
    monkeypatch.setattr(N, "CROWDED", 1)
    rows = family(random.Random(5), 60, 6)
    got, want = pairs(spark, rows, anchor_limit=12)[1], brute(rows)
    assert set(got) <= set(want) and len(got) == len(set(got)) and len(got) >= 0.99 * len(want)
