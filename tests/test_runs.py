"""Quantiles, grids, scoring runs and gates on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import describe as D
from panelwright.operators import grid as G
from panelwright.operators import manifest as M
from panelwright.operators import panel as P
from panelwright.operators import recode as R
from panelwright.operators import runs as U
from panelwright.operators import text as W
from panelwright.operators.contracts import ContractError
from panelwright.operators.lexicon import DEFAULT_TERMS
from panelwright.operators.quantiles import exact_quantiles


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.r_[np.zeros(300), rng.integers(0, 5, 200)], "c": np.array([7.0]), None: rng.normal(size=20), "n": np.array([1.0, 2.0, np.nan])}
    rows = [(g, float(v), 1) for g, vs in groups.items() for v in vs] + [("a", None, 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, p int").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {(g, p) for g in groups for p in probs}
    for g, vs in groups.items():
        for p in probs:
            want = np.quantile(np.sort(vs)[: 2 if g == "n" and p <= 0.5 else None], p if g != "n" else min(1.0, 2 * p)) if g != "n" or p <= 0.5 else np.nan
            assert got[g, p] == pytest.approx(want, nan_ok=True)
    assert exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0
    assert [tuple(r) for r in exact_quantiles(df.filter("g = 'c'"), [], "v", [0.5]).collect()] == [(0.5, 7.0)]


def test_statistics_with_quantiles(spark):
    df = spark.createDataFrame([("x", 1.0, True), ("x", 3.0, True), ("x", None, False), ("y", 5.0, False), (None, 2.0, None)], "g string, v double, arm boolean")
    rows = {r["g"]: r for r in D.summary_table(df, ["v"], ["g"]).collect()}
    assert (rows["x"]["n"], rows["x"]["median"], rows["x"]["p75"]) == (2, 2.0, 2.5) and rows[None]["median"] == 2.0
    assert D.quick_stats(df.limit(0), "v").first()["p50"] is None and D.quick_stats(df, "v").first()["p50"] == 2.5
    assert [(r["median_treated"], r["median_control"]) for r in D.standardized_difference(df, "arm", ["v"]).collect()] == [(2.0, 5.0)]
    wide = P.winsorize(df.withColumn("none", F.lit(None).cast("double")), ["v", "none"], 0.0, 0.5)
    assert sorted(r["v_w"] for r in wide.collect() if r["v_w"] is not None) == [1.0, 2.0, 2.5, 2.5] and wide.filter("none_w is not null").count() == 0


def test_recodes(spark):
    df = spark.createDataFrame([(1, 2019, None, 10.0, "b"), (2, None, -3.0, 10.0, "a"), (3, 2021, 4.0, 0.0, "a")], "id int, year int, x double, a double, k string")
    assert R.year_cap(df, "year", 2020).count() == 1 and R.year_cap(df, "year", 0).count() == 3
    assert R.rename_prefixes(df, {"y": "z", "ye": "q"}).columns == ["id", "qar", "x", "a", "k"]
    got = [tuple(r) for r in R.spending(df, "x", "a", "s").select("s", "s_binary", "s_intensity").orderBy("id").collect()]
    assert got == [(0.0, 0, 0.0), (None, None, None), (4.0, 1, None)]
    assert [r["rank"] for r in R.stable_rank(df, [], [F.col("k").asc()], "id").orderBy("id").collect()] == [3, 1, 2]
    assert [tuple(r) for r in R.sorted_counts(df, ["k"]).orderBy("place").collect()] == [("a", 2, 1), ("b", 1, 2)] and R.head(df, ["k"], [F.col("id").desc()], 1).count() == 2


def test_grid(spark):
    cells = G.grid(spark, {"o": ["x", "y"], "n": [1, 2]}, "o string, n int", drop=lambda c: c["o"] == "y" and c["n"] == 1, seed=7)
    assert [tuple(r) for r in cells.orderBy("model").collect()] == [("x", 1, 1, 7), ("x", 2, 2, 8), ("y", 2, 3, 9)]
    out = G.over_grid(cells, lambda c: spark.range(c["n"]).select(F.lit(c["o"]).alias("got"), "id"))
    assert out.count() == 5 and out.filter("o <> got").count() == 0
    assert G.missing_outputs(cells, out.filter("o = 'x'"), ["o", "n"]).count() == 1 and G.without(["roa", "size"], "profit", {"profit": "roa"}) == ["size"]
    rows = spark.createDataFrame([("r", "a", 1.23456, 0.5), ("r", "b", -0.0001, None)], "r string, c string, e double, s double")
    table = G.publication_rows(rows, "r", "c", F.col("e"), F.col("s"), F.when(F.col("e") > 1, "*").otherwise(""), ["a", "b", "z"])
    assert sorted(tuple(r) for r in table.collect()) == [("r", 1, "1.235*", "0.000", ""), ("r", 2, "(0.500)", "", "")]


def test_chunk_and_repair(spark):
    def stub():
        return lambda pairs: [(k, "" if "bad" in p else "2") for k, p in pairs]

    rows = [("1", "u1", " c ", 2019, "good text", 3), ("2", "u1", None, 2019, "bad text", 1), ("3", "u2", "d", 2025, "late", 1), ("4", "u2", "d", 2020, "no term", 0), ("5", "u2", "d", 2020, None, None), ("6", "u2", "d", None, "good", 1)]
    df = spark.createDataFrame(rows, "id string, chunk string, cik string, year int, t string, h int")
    done = U.process_chunk(df, "id", "t", "h", stub, settings={"run_id": "r"}, last_year=2020, limit=8)
    got = {r["id"]: (r["decision"], r["ai_score"], r["parse_status"], r["endpoint_attempts"], r["at_limit"], r["cik"]) for r in done.collect()}
    assert got == {"1": ("call", 2, "success", 1, True, "c"), "2": ("call", None, "failed", 2, True, ""), "4": ("zero_no_keyword", 1, "not_called", 0, False, "d"), "5": ("empty_text", None, "not_called", 0, False, "d")}
    report = {r["chunk"]: r for r in U.chunk_summary(done.withColumnRenamed("h", "hh"), "chunk").collect()}
    assert (report["u1"]["state"], report["u1"]["failure_share"], report["u2"]["state"], report["u2"]["called"]) == ("partial", 0.5, "complete", 0)
    assert [r["id"] for r in U.failed_rows(done).collect()] == ["2"]
    fixed = U.repaired(done.withColumn("t", F.regexp_replace("t", "bad", "fine")), "id", "t", stub, ["run_id"])
    assert {r["id"]: (r["ai_score"], r["parse_status"], r["repaired"]) for r in fixed.collect()}["2"] == (2, "success", True) and fixed.filter("repaired").count() == 1
    with pytest.raises(ContractError):
        U.repaired(done.withColumn("run_id", F.col("id")), "id", "t", stub, ["run_id"])
    assert U.process_chunk(df.limit(0), "id", "t", "h", stub).count() == 0


def test_prompt_overhead(spark):
    row = U.with_prompts(spark.createDataFrame([("x" * 2400,), (" ",)], "t string"), "t").collect()
    assert (len(row[0]["prompt"]), len(row[0]["retry_prompt"]), row[1]["prompt"]) == (3379, 3463, None)


def test_gates(spark):
    manifest = spark.createDataFrame([("extracted",), ("failed",), (None,), ("no_keyword",)], "extract_status string")
    assert sorted(map(tuple, U.incomplete(manifest).collect()), key=repr) == [("failed", 1), (None, 1)]
    with pytest.raises(ContractError, match="failed 1"):
        U.require_complete(manifest)
    assert U.require_complete(manifest.filter("extract_status = 'extracted'")).count() == 1
    left, right = spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), spark.createDataFrame([("a",), ("d",)], "c string")
    assert sorted(map(tuple, U.parity(left, right, "c").collect())) == [("a", 2, 1, False), ("b", 1, -1, False), ("d", -1, 1, False)]
    windows = spark.createDataFrame([("k", 1, "We use AI.", "ai"), ("k", 2, "More ML", "ML|GPT"), ("z", 1, "x", "")], "k string, i int, t string, m string").withColumn("h", F.sha2("t", 256))
    results = spark.createDataFrame([("k", 2), ("z", 1), ("none", 0)], "k string, n int")
    assert [tuple(r) for r in M.validate_results(results, windows, "k", "n", "t", "h", "i", "m").collect()] == [("k", "missing term")] and M.validate_results(results, windows, "k", "n", "t", "h", "i").count() == 0


def test_document_formats(spark):
    page = "<DOCUMENT><TYPE>EX-1\n<TEXT>no</TEXT></DOCUMENT><document><type>10-K\n<TEXT>yes <pre>a &lt; b</pre><PRE>c</PRE></TEXT></document>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, p string")
    assert [r["body"] for r in W.submission_bodies(df, ["id"], "p", "10-k").orderBy("id").collect()] == ["yes <pre>a &lt; b</pre><PRE>c</PRE>", None, None]
    assert sorted(map(tuple, W.pre_blocks(df, ["id"], "p").collect())) == [(1, 0, "a < b"), (1, 1, "c")]
    texts = spark.createDataFrame([(1, "We use AI."), (2, "nothing"), (3, None), (4, "AI")], "id int, p string")
    states = W.extraction_states(texts, "id", "p", DEFAULT_TERMS, texts.filter("id = 4"))
    assert {r["id"]: (r["state"], r["windows"]) for r in states.collect()} == {1: ("extracted", 1), 2: ("no_keyword", 0), 3: ("no_keyword", 0), 4: ("skipped_valid", 0)}
