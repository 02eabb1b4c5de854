"""Panels, paths, manifests, contracts, estimators, sources and incremental runs on small tables."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.estimators import did, lpm
from panelwright.operators import contracts as C
from panelwright.operators import describe as D
from panelwright.operators import manifest as M
from panelwright.operators import panel as P
from panelwright.operators import paths as H
from panelwright.operators import treatment as R
from panelwright.sources import readers
from panelwright.streaming.resume import existing, process_new_files


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_lags_across_gaps(spark):
    df = spark.createDataFrame([("a", 2019, 1.0), ("a", 2020, 2.0), ("a", 2022, 3.0), (None, 2020, 9.0)], "f string, y int, x double")
    got = {(r["f"], r["y"]): (r["x_l1"], r["lag_is_consecutive"]) for r in P.consecutive_lags(df, "f", "y", ["x"]).collect()}
    assert got == {("a", 2019): (None, False), ("a", 2020): (1.0, True), ("a", 2022): (None, False), (None, 2020): (None, False)}


def test_winsorize_nulls(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(101)] + [(None, None)], "x double, z double")
    got = P.winsorize(df, ["x", "z"]).agg(F.min("x_w"), F.max("x_w"), F.count("x_w"), F.count("z_w")).first()
    assert tuple(got) == (1.0, 99.0, 101, 0)


def test_best_row_ties(spark):
    df = spark.createDataFrame([("a", 1, None, 1), ("a", 2, 5.0, 2), ("a", 3, 5.0, 3)], "k string, d int, x double, t int")
    assert rows(P.most_complete_row(df, ["k"], ["x"], "d", "t"), "t") == [(3,)]


def test_canonical_filing(spark):
    data = [("a", "2020", "2021-02-01", "10-K/A", "1"), ("a", "2020", "2021-03-01", "10-K", "2"), ("b", "2020", "2021-02-01", "10-K/A", "3"), ("c", "2020", None, "10-K", "4"), ("c", "2020", "2021-01-01", "10-K", "5"), ("d", "2020", "x", "8-K", "6")]
    df = spark.createDataFrame(data, "f string, p string, d string, form string, acc string")
    assert rows(R.canonical_filing(df, "f", "p", "d", "form", "acc"), "f", "acc") == [("a", "2"), ("b", "3"), ("c", "5")]


def test_treatment_is_strictly_after(spark):
    panel = spark.createDataFrame([("a", 1, 2019), ("a", 2, 2020), ("b", 5, 2020), ("c", 5, 2020)], "f string, d int, y int")
    dates = R.treatment_dates(spark.createDataFrame([("a", 1, 2), ("b", 9, 3), ("b", 1, 1)], "f string, d int, s int"), "f", "d", "s")
    got = rows(R.absorbing_treatment(panel, dates, "f", "d", "y"), "f", "y", "adopted", "adoption_year")
    assert got == [("a", 2019, 0, 2020), ("a", 2020, 1, 2020), ("b", 2020, 0, 0), ("c", 2020, None, None)]


def test_paths(spark):
    paths = {"a": [0, 1, 2], "b": [0, 2], "c": [2, 1, 2], "d": [1]}
    df = spark.createDataFrame([(f, 2000 + i, s) for f, p in paths.items() for i, s in enumerate(p)], "f string, y int, s int")
    got = {r["f"]: (r["path"], r["n_up"], r["n_down"], r["ordered_0_1_2"], r["direct_0_2"]) for r in H.path_summary(df, "f", "y", "s").collect()}
    assert got == {"a": ("0->1->2", 2, 0, True, False), "b": ("0->2", 1, 0, False, True), "c": ("2->1->2", 1, 1, False, False), "d": ("1", 0, 0, False, False)}
    assert rows(H.first_switch(df, "f", "y", "s"), "f", "initial", "first_switch_year", "direction") == [("a", 0, 2001, 1), ("b", 0, 2001, 1), ("c", 2, 2001, -1), ("d", 1, None, None)]


def test_merge_intervals(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 3, 4), ("a", 6, 7), ("a", 1, 1)], "k string, b int, e int")
    assert rows(H.merge_intervals(df, ["k"], "b", "e"), "b", "e", "n_intervals") == [(0, 4, 3), (6, 7, 1)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(C.ContractError):
        C.require_unique(df, ["k"])
    with pytest.raises(C.ContractError):
        C.require_columns(df, ["z"])
    with pytest.raises(C.ContractError):
        C.require_none(df, {"a": F.col("v") == "a"})
    with pytest.raises(C.ContractError):
        C.lookup_join(df, df, ["k"])
    assert rows(C.key_difference(df, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]), "k", "side") == [(None, "right")]


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "x double, g int")
    assert D.quick_stats(df, "x").first()["n"] == 0
    assert D.correlation(spark.createDataFrame([(1.0, 2.0)] * 6, "a double, b double"), "a", "b").first()["correlation"] is None


def test_manifest_from_parallel_arrays(spark):
    doc = {"name": "F", "filings": {"recent": {"accessionNumber": ["1", "2", "3", "1"], "form": ["10-K", "10-K/A", "8-K", "10-K"], "filingDate": ["2021-02-01", "2021-05-01", "2021-01-01", "2021-02-01"], "reportDate": ["2020-12-31", ""], "primaryDocument": []}}}
    page = {k: v[:1] for k, v in doc["filings"]["recent"].items()} | {"accessionNumber": ["9"], "reportDate": ["2018-12-31"]}
    df = spark.createDataFrame([("7", json.dumps(doc)), ("7", json.dumps(page)), ("8", "not json")], "cik string, p string")
    lookup = spark.createDataFrame([("7", 2020), ("7", 2021), ("7", 2018)], "cik string, year int")
    got = M.build_manifest(M.rows_of_columns(df, "cik", "p"), lookup, ["10-K", "10-K/A"])
    assert rows(got, "accessionNumber", "year", "year_match_method") == [("1", 2020, "report_date"), ("2", 2021, "filing_date"), ("9", 2018, "report_date")]


def test_storage_batches(spark):
    df = spark.createDataFrame([("s", i, 60) for i in range(5)], "g string, i int, n long")
    assert rows(M.storage_batches(df, "g", ["i"], "n", 100), "i", "batch") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def greedy_quotas(counts, total):
    """Seats one by one: whole shares (at least one where all can have one), then up or down by the distance from the share."""
    from fractions import Fraction

    size = sum(counts.values())
    total = min(total, size)
    share = {k: Fraction(total * n, size) if size else Fraction(0) for k, n in counts.items()}
    least = {k: int(n > 0 and total >= sum(m > 0 for m in counts.values())) for k, n in counts.items()}
    out = {k: min(n, max(least[k], int(share[k]))) for k, n in counts.items()}
    while sum(out.values()) != total:
        step = 1 if sum(out.values()) < total else -1
        free = [k for k in counts if (out[k] < counts[k] if step > 0 else out[k] > least[k])]
        out[max(free, key=lambda k: (step * (share[k] - out[k]), str(k)))] += step
    return out


def test_quotas_seat_by_seat(spark):
    import random

    rng = random.Random(3)
    cases = [{"a": 100, "b": 20}, {"a": 1000, "b": 1}, {"a": 0, "b": 3}, {"a": 7, "b": 7, "c": 7}, {k: 1 for k in "abcdefgh"} | {"z": 500}] + [{chr(97 + i): rng.choice([0, 1, 1, 2, 5, 90, 300]) for i in range(rng.randint(1, 9))} for _ in range(40)]
    totals = [rng.randint(0, 40) for _ in cases]
    rows = [(i, t, k, n) for i, (c, t) in enumerate(zip(cases, totals)) for k, n in c.items()]
    got: dict = {}
    for r in M.proportional(spark.createDataFrame(rows, "g int, t long, k string, n long"), ["g"], "k", "n", F.col("t")).collect():
        got.setdefault(r["g"], {})[r["k"]] = r["quota"]
    assert got == {i: greedy_quotas(c, t) for i, (c, t) in enumerate(zip(cases, totals))}


def test_quotas_and_sample(spark):
    df = spark.createDataFrame([(i, "k" if i % 6 else "a", 2000 + i % 4) for i in range(120)], "id int, form string, y int")
    one = rows(M.stratified_sample(df, "form", "y", "id", 30, "s"), "id")
    assert len(one) == 30 and one == rows(M.stratified_sample(df.repartition(7), "form", "y", "id", 30, "s"), "id")


def test_sample_prefers_unseen_units(spark):
    """Against a plain loop over the strata."""
    import hashlib
    import random

    rng = random.Random(6)
    data = [(f"r{i}", f"u{min(rng.randint(0, 60), 25)}", rng.choice(["a", "b"]), 2000 + rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(data, "id string, u string, form string, y int")
    got = {r["id"] for r in M.stratified_sample(df, "form", "y", "id", 40, "s", unit="u").collect()}
    forms = greedy_quotas({f: sum(r[2] == f for r in data) for f in "ab"}, 40)
    want, used = set(), set()
    for f in "ab":
        years = sorted({r[3] for r in data if r[2] == f})
        for y, n in greedy_quotas({y: sum(r[2:] == (f, y) for r in data) for y in years}, forms[f]).items():
            pool = sorted((r for r in data if r[2:] == (f, y)), key=lambda r: (hashlib.sha256(f"s|{r[0]}".encode()).hexdigest(), r[0]))
            mine = []
            for fresh in (True, False):
                for r in pool:
                    if len(mine) < n and r not in mine and (not fresh or r[1] not in used):
                        mine.append(r)
                        used.add(r[1])
            want |= {r[0] for r in mine}
    assert got == want and len(got) == 40


def test_history_pages(spark):
    pages = spark.createDataFrame([("1", "p1", "2001-01-01", "2004-01-01"), ("1", "p2", "2010-01-01", "2012-01-01"), ("2", "p3", None, "x")], "cik string, page string, a string, b string")
    years = spark.createDataFrame([(2003,)], "y int")
    assert {r["page"] for r in M.relevant_pages(pages, years, "a", "b", "filing_date").collect()} == {"p1", "p3"} and M.relevant_pages(pages, years, "a", "b").count() == 3
    assert M.require_pages(pages, pages, ["page"]).count() == 3
    with pytest.raises(C.ContractError, match="p2"):
        M.require_pages(pages, pages.filter("page <> 'p2'"), ["page"])


def test_chunks_never_divide_a_unit(spark):
    df = spark.createDataFrame([(f"u{i // 3:03d}", i) for i in range(60)], "u string, i int")
    got = M.chunk_numbers(df, "u", 4).groupBy("u").agg(F.count_distinct("chunk_id").alias("n"), F.max("chunk_id").alias("c")).collect()
    assert all(r["n"] == 1 and r["c"] == int(r["u"][1:]) // 4 + 1 for r in got)


def _panel(spark, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for f in range(60):
        g = [0, 2004, 2006][f % 3]
        for t in range(2000, 2010):
            if rng.random() < 0.9:
                data.append((f, t, g, float(rng.normal() + (1.5 if g and t >= g else 0) + 0.1 * (t - 2000)), float(rng.normal())))
    return data, spark.createDataFrame(data, "f int, t int, g int, y double, x double")


def _cell(data, g, t, covariate=False):
    b = t - 1 if t < g else g - 1
    y = {(r[0], r[1]): r for r in data}
    arms = {0: [], 1: []}
    for f in {r[0] for r in data}:
        if (f, t) in y and (f, b) in y:
            c = y[f, t][2]
            if c == g or c == 0 or c > max(t, b):
                arms[int(c == g)].append((y[f, t][3] - y[f, b][3], y[f, b][4]))
    a, c = np.array(arms[1]), np.array(arms[0])
    if covariate:
        beta = np.linalg.lstsq(np.c_[np.ones(len(c)), c[:, 1]], c[:, 0], rcond=None)[0]
        return a[:, 0].mean() - (np.c_[np.ones(len(a)), a[:, 1]] @ beta).mean()
    return a[:, 0].mean() - c[:, 0].mean()


def test_att_gt(spark):
    data, df = _panel(spark)
    got = {(r["g"], r["t"]): r["att"] for r in did.att_gt(did.did_sample(df, "f", "t", "g", "y")).collect()}
    assert len(got) == 18
    for (g, t), att in got.items():
        assert att == pytest.approx(_cell(data, g, t))
    adjusted = {(r["g"], r["t"]): r["att"] for r in did.att_gt_adjusted(did.did_sample(df, "f", "t", "g", "y", ["x"])).collect()}
    for (g, t), att in adjusted.items():
        assert att == pytest.approx(_cell(data, g, t, True))


def test_event_study(spark):
    _, df = _panel(spark)
    out = did.event_study(did.did_sample(df, "f", "t", "g", "y"), -3, 3)
    by = {e["event_time"]: e for e in out["effects"]}
    assert by[0]["att"] == pytest.approx(1.5, abs=0.8) and by[0]["low"] < by[0]["att"] < by[0]["high"] and out["critical"] > 1.96
    assert 0 <= out["wald"]["p_value"] <= 1 and out["wald"]["df"] == 3
    assert did.gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)


def test_two_effects_equal_dummies(spark):
    rng = np.random.default_rng(1)
    n = 400
    f, t, i = rng.integers(0, 40, n), rng.integers(0, 5, n), rng.integers(0, 6, n)
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 2 * x - z + t * 0.5 + i + rng.normal(size=n)
    df = spark.createDataFrame([(int(a), int(b), int(c), float(d), float(e), float(g)) for a, b, c, d, e, g in zip(f, t, i, y, x, z)], "f int, t int, i int, y double, x double, z double")
    out = {r["term"]: r for r in lpm.two_effects(df, "y", ["x", "z"], "t", "i", "f")}
    design = np.c_[x, z, np.eye(5)[t], np.eye(6)[i][:, :-1]]
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    inv = np.linalg.inv(design.T @ design)
    e = y - design @ beta
    score = np.array([(design[f == k] * e[f == k, None]).sum(0) for k in np.unique(f)])
    g = len(score)
    v = inv @ score.T @ score @ inv * g / (g - 1) * (n - 1) / (n - design.shape[1])
    assert out["x"]["estimate"] == pytest.approx(beta[0]) and out["z"]["std_error"] == pytest.approx(v[1, 1] ** 0.5)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text("cik,n\n0001,1\n0002,zz\n")
    (tmp_path / "y.csv").write_text("")
    got = rows(readers.read_csv_folder(spark, str(tmp_path), "cik string, n int"), "cik", "n", "source_csv")
    assert got == [("0001", 1, "x.csv"), ("0002", None, "x.csv")]
    (tmp_path / "big.txt").write_text("a|AIUSE|1\nb|OTHER|2\nc|AIUSE|\n")
    assert rows(readers.read_marked_lines(spark, str(tmp_path / "big.txt"), "AIUSE", ["k", "m", "v"]), "k", "v") == [("a", "1"), ("c", None)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("CIK1.json", '{"name": "n"}')
        z.writestr("bad.json", "{")
        z.writestr("note.txt", "x")
    assert rows(readers.read_zip_json(spark, str(tmp_path / "z.zip")), "member", "payload") == [("CIK1.json", '{"name": "n"}'), ("bad.json", None)]
    assert readers.with_start_date("where datadate >= '2015-01-01'", "2012-01-01") == "where datadate >= '2012-01-01'"
    with pytest.raises(ValueError):
        readers.with_start_date("select 1", "2012-01-01")
    chunks = readers.list_chunks(["p/chunk_00002.parquet", "p/chunk_00001.parquet", "p/other"])
    assert readers.select_chunks(chunks, span=(2, 9)) == ["p/chunk_00002.parquet"] and readers.select_chunks(chunks, most=1) == ["p/chunk_00001.parquet"]
    with pytest.raises(ValueError):
        readers.select_chunks(chunks, ids=[7])
    df = spark.createDataFrame([("a|b\nc", 1)], "`My Col!` string, `my-col` int")
    assert readers.clean_names(df).columns == ["my_col", "my_col_2"] and "a\\|b c" in readers.markdown(df)


def test_incremental_run_is_idempotent(spark, tmp_path):
    source, results, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "k string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(source, mode="append")
    step = lambda df: df.withColumn("v", F.col("v") * 10)
    for _ in range(2):
        process_new_files(spark, source, schema, step, results, point, ["k"])
    spark.createDataFrame([("b", 7), ("c", 3)], schema).write.parquet(source, mode="append")
    process_new_files(spark, source, schema, step, results, point, ["k"])
    assert rows(existing(spark, results, spark.createDataFrame([], schema).schema), "k", "v") == [("a", 10), ("b", 20), ("c", 30)]
