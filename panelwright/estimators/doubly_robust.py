"""Doubly robust effects by cohort and year with multiplier bootstrap.

Cells of cohort and year are those of `did`. In each, controls' changes are regressed on the covariates and treatment by a
logistic model of the same covariates; the estimate is right if either holds (Sant'Anna and Zhao 2020). All cells are worked on
at once: every step is one sum of products by cell in Spark, and only those sums, whose number is bounded by cohorts, years and
covariates, reach the driver. Influences are summed per firm where they are; draws of multipliers are made from the firm's hash
on the workers, so that only sums by draw come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.estimators.did import _cells, changes, gamma_upper
from panelwright.session import cut

#: Newton steps of the logistic model and the largest change at which it counts as solved.
STEPS, TOLERANCE = 25, 1e-9
#: Propensity above which a control has no weight worth having.
MOST_LIKELY = 1 - 1e-6


def _products(names: list[str], weight: Column) -> list[Column]:
    return [F.sum(weight * F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]


def _square(row, k: int) -> np.ndarray:
    return np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)


def _with(rows: DataFrame, values: dict[tuple, dict[str, float]]) -> DataFrame:
    """rows with the numbers of their cell, one row per cell sent along."""
    names = list(next(iter(values.values())))
    small = rows.sparkSession.createDataFrame([(g, t, *map(float, v.values())) for (g, t), v in values.items()], "g int, t int, " + ", ".join(f"{n} double" for n in names))
    return rows.join(F.broadcast(small), ["g", "t"])


def _dot(names: list[str], prefix: str) -> Column:
    return sum((F.col(x) * F.col(f"{prefix}{i}") for i, x in enumerate(names)), F.lit(0.0))


def att_gt_robust(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, influence): g, t, n_treated, n_control, att, se of each cell, and firm, g, t, influence of each firm in it.

    Covariates x0.. are those of the earlier year; without any this is the difference of mean changes. Cells without treated
    firms, or with no more controls than coefficients, are left out, as are those whose logistic model doesn't settle.
    """
    spark = sample.sparkSession
    pairs = changes(sample).withColumn("one", F.lit(1.0))
    names = ["one", *(c for c in sample.columns if c.startswith("x"))]
    k = len(names)
    d = F.col("treated").cast("double")
    rows = cut(_cells(pairs).select("firm", "g", "t", "treated", "dy", *names), "cells")
    sums = rows.groupBy("g", "t").agg(F.sum("treated").alias("n1"), F.count(F.lit(1)).alias("n"), *(F.sum((1 - d) * F.col(x) * F.col("dy")).alias(f"y_{i}") for i, x in enumerate(names)), *_products(names, 1 - d)).collect()
    cells: dict[tuple, dict] = {}
    for r in sums:
        if r["n1"] and r["n"] - r["n1"] > k:
            gram = _square(r, k)
            if np.linalg.matrix_rank(gram) == k:
                cells[r["g"], r["t"]] = {"n": r["n"], "n1": r["n1"], "inverse": np.linalg.inv(gram / r["n"]), "beta": np.linalg.solve(gram, np.array([r[f"y_{i}"] for i in range(k)])), "gamma": np.zeros(k)}
    empty = "g int, t int, n_treated long, n_control long, att double, se double", "firm string, g int, t int, influence double"
    if not cells:
        return tuple(spark.createDataFrame([], s) for s in empty)
    # Newton steps of all cells' logistic models together; settled cells drop out.
    open_cells = set(cells)
    for _ in range(STEPS):
        if not open_cells:
            break
        now = _with(rows, {c: {f"c{i}": v for i, v in enumerate(cells[c]["gamma"])} for c in open_cells})
        p = 1 / (1 + F.exp(-_dot(names, "c")))
        now = now.withColumn("__p", p)
        for r in now.groupBy("g", "t").agg(*(F.sum((d - F.col("__p")) * F.col(x)).alias(f"s_{i}") for i, x in enumerate(names)), *_products(names, F.col("__p") * (1 - F.col("__p")))).collect():
            c = r["g"], r["t"]
            information = _square(r, k)
            step = np.linalg.pinv(information) @ np.array([r[f"s_{i}"] for i in range(k)])
            cells[c]["information"] = information
            cells[c]["gamma"] = cells[c]["gamma"] + np.clip(step, -5, 5)
            if np.abs(step).max() < TOLERANCE:
                open_cells.discard(c)
    cells = {c: v for c, v in cells.items() if c not in open_cells}
    if not cells:
        return tuple(spark.createDataFrame([], s) for s in empty)
    fit = _with(rows, {c: {**{f"b{i}": v for i, v in enumerate(x["beta"])}, **{f"c{i}": v for i, v in enumerate(x["gamma"])}} for c, x in cells.items()})
    fit = fit.withColumns({"__r": F.col("dy") - _dot(names, "b"), "__p": F.least(1 / (1 + F.exp(-_dot(names, "c"))), F.lit(MOST_LIKELY))})
    w = F.when(F.col("treated") == 1, 0.0).otherwise(F.col("__p") / (1 - F.col("__p")))
    fit = fit.withColumn("__w", w).select("firm", "g", "t", "treated", *names, "__r", "__p", "__w")
    moments = fit.groupBy("g", "t").agg(F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__r")).alias("wr"), F.sum(d * F.col("__r")).alias("dr"), *(F.sum(d * F.col(x)).alias(f"d_{i}") for i, x in enumerate(names)), *(F.sum(F.col("__w") * F.col(x)).alias(f"w_{i}") for i, x in enumerate(names)), *(F.sum(F.col("__w") * F.col("__r") * F.col(x)).alias(f"q_{i}") for i, x in enumerate(names)))
    values = {}
    for r in moments.collect():
        c = r["g"], r["t"]
        x = cells[c]
        n, n1 = x["n"], x["n1"]
        treated, control = r["dr"] / n1, r["wr"] / r["w"]
        vector = lambda s: np.array([r[f"{s}_{i}"] for i in range(k)]) / n  # noqa: B023, E731
        # What an estimated coefficient adds to a firm's influence, as a vector to be multiplied with its covariates.
        ols = x["inverse"] @ (vector("d") / (n1 / n) - vector("w") / (r["w"] / n))
        logit = np.linalg.pinv(x["information"] / n) @ (vector("q") - control * vector("w")) / (r["w"] / n)
        x.update(att=treated - control)
        values[c] = {"m1": n1 / n, "mw": r["w"] / n, "e1": treated, "e0": control, "n": n, **{f"o{i}": v for i, v in enumerate(ols)}, **{f"l{i}": v for i, v in enumerate(logit)}}
    part = _with(fit, values)
    one = d * (F.col("__r") - F.col("e1")) / F.col("m1")
    other = F.col("__w") * (F.col("__r") - F.col("e0")) / F.col("mw") + (d - F.col("__p")) * _dot(names, "l")
    slope = (1 - d) * F.col("__r") * _dot(names, "o")
    influence = part.select("firm", "g", "t", ((one - slope - other) / F.col("n")).alias("influence"))
    influence = cut(influence, "influence")
    errors = influence.groupBy("g", "t").agg(F.sqrt(F.sum(F.col("influence") ** 2)).alias("se"))
    estimates = spark.createDataFrame([(g, t, int(x["n1"]), int(x["n"] - x["n1"]), float(x["att"])) for (g, t), x in cells.items()], "g int, t int, n_treated long, n_control long, att double")
    return estimates.join(F.broadcast(errors), ["g", "t"]).select("g", "t", "n_treated", "n_control", "att", "se"), influence


def _multipliers(hashes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(firms, draws) of 1 and -1, told by the firm's hash alone."""
    from numpy.random import Philox

    words = -(-draws // 64)
    bits = np.empty((len(hashes), words * 64), np.int8)
    for i, h in enumerate(hashes.astype(np.uint64).tolist()):
        raw = Philox(key=[h, seed]).random_raw(words)
        bits[i] = np.unpackbits(raw.view(np.uint8)).view(np.int8)
    return bits[:, :draws].astype(np.float32) * 2 - 1


def bootstrap(influence: DataFrame, weights: dict[str, dict[tuple, float]], draws: int = 1000, seed: int = 1) -> dict[str, np.ndarray]:
    """For each named combination of cells (weights per cell) its bootstrap deviations, one per draw."""
    names = list(weights)
    small = influence.sparkSession.createDataFrame([(g, t, [float(weights[n].get((g, t), 0.0)) for n in names]) for g, t in sorted({c for w in weights.values() for c in w})], "g int, t int, w array<double>")
    rows = influence.join(F.broadcast(small), ["g", "t"])  # one row per cell
    firms = rows.groupBy("firm").agg(*(F.sum(F.col("influence") * F.col("w")[i]).alias(f"i{i}") for i in range(len(names))))
    firms = firms.select(F.xxhash64("firm").alias("h"), *(f"i{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(names)))
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            values = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], 1)
            for low in range(0, len(hashes), 4096):
                total += _multipliers(hashes[low : low + 4096], draws, seed).T @ values[low : low + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int32()), *(pa.array(total[:, i].copy()) for i in range(len(names)))], ["draw", *(f"i{i}" for i in range(len(names)))])

    schema = T.StructType([T.StructField("draw", T.IntegerType()), *(T.StructField(f"i{i}", T.DoubleType()) for i in range(len(names)))])
    sums = firms.mapInArrow(run, schema).groupBy("draw").agg(*(F.sum(f"i{i}").alias(f"i{i}") for i in range(len(names)))).orderBy("draw").toArrow()
    return {n: sums.column(f"i{i}").to_numpy() for i, n in enumerate(names)}


def dynamic_effects(sample: DataFrame, first: int = -4, last: int = 6, draws: int = 1000, level: float = 0.95, seed: int = 1) -> dict:
    """Effects by years since treatment and over all, with bootstrap errors, a uniform band and the Wald test before treatment.

    A cell weighs by its treated firms. Errors are interquartile ranges of the draws over the normal's, and the band's critical
    value is the quantile of the largest absolute t of a draw.
    """
    cells, influence = att_gt_robust(sample)
    found = [r for r in cells.collect() if first <= r["t"] - r["g"] <= last]
    if not found:
        return {"effects": [], "overall": None, "wald": None, "critical": None}
    times = sorted({r["t"] - r["g"] for r in found})
    groups: dict[str, list] = {str(e): [r for r in found if r["t"] - r["g"] == e] for e in times}
    after = [r for r in found if r["t"] >= r["g"]]
    if after:
        groups["overall"] = after
    share = {n: {(r["g"], r["t"]): r["n_treated"] / sum(x["n_treated"] for x in rs) for r in rs} for n, rs in groups.items()}
    effect = {n: sum(r["att"] * share[n][r["g"], r["t"]] for r in rs) for n, rs in groups.items()}
    dev = bootstrap(influence, share, draws, seed)
    width = 2 * 0.6744897501960817
    error = {n: float(np.subtract(*np.quantile(v, [0.75, 0.25])) / width) for n, v in dev.items()}
    ts = np.stack([np.abs(dev[str(e)]) / error[str(e)] if error[str(e)] > 0 else np.zeros(draws) for e in times])
    critical = float(np.quantile(ts.max(axis=0), level))
    before = [str(e) for e in times if e < 0]
    wald = None
    if before:
        v = np.atleast_2d(np.cov(np.stack([dev[b] for b in before])))
        b = np.array([effect[x] for x in before])
        statistic = float(b @ np.linalg.pinv(v) @ b)
        wald = {"statistic": statistic, "df": len(before), "p_value": gamma_upper(len(before) / 2, statistic / 2)}
    rows = [{"event_time": e, "att": float(effect[str(e)]), "se": error[str(e)], "low": float(effect[str(e)] - critical * error[str(e)]), "high": float(effect[str(e)] + critical * error[str(e)])} for e in times]
    return {"effects": rows, "overall": {"att": float(effect["overall"]), "se": error["overall"]} if after else None, "wald": wald, "critical": critical}
