"""Linear probability models with absorbed fixed effects and clustered errors.

Two aggregations leave cell sums of bounded size (columns times fixed-effect levels) for the driver; rows stay in Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def risk_set(panel: DataFrame, year: str, cohort: str, first_cohort: int) -> DataFrame:
    """Rows up to and including the event of firms first treated in first_cohort or later, and all rows of never treated
    ones (cohort 0), with event 1 in the year of the event. Rows with a null cohort are left out."""
    c = F.col(cohort)
    kept = panel.filter(c.isNotNull() & ((c == 0) | ((c >= first_cohort) & (F.col(year) <= c))))
    return kept.withColumn("event", (F.col(year) == c).cast("int"))


def event_faults(risk: DataFrame, firm: str, cohort: str) -> DataFrame:
    """(firm, events): treated firms of a risk set that don't have exactly one event; never treated ones that have any."""
    events = risk.groupBy(firm).agg(F.sum("event").alias("events"), F.max(F.col(cohort) > 0).alias("__t"))
    return events.filter(F.col("events") != F.col("__t").cast("int")).drop("__t")


def one_effect_slope(df: DataFrame, y: str, x: str, effect: str) -> DataFrame:
    """(n, slope) of y on x within the levels of one fixed effect: ratio of the within-level sums of products."""
    known = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(effect).isNotNull())
    cells = known.groupBy(effect).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"))
    return cells.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("c")), F.sum(F.col("n") * F.col("v"))).alias("slope"))


def two_effects(df: DataFrame, y: str, xs: list[str], first: str, second: str, cluster: str) -> list[dict]:
    """Coefficients of xs on y with two sets of fixed effects and errors clustered by cluster.

    Rows with a null in any of the columns are left out. The pass over the rows yields, per pair of effect levels, counts,
    sums and products; the normal equations are solved on the driver. A second pass sums scores by cluster and combines
    them to the sandwich. Factor: G / (G - 1) * (n - 1) / (n - K), K counting slopes and effect levels. A result has term,
    estimate, std_error, statistic, p_value (normal), n, r2, a 95 % interval (low, high) and within_r2, the share of what the
    fixed effects leave.
    """
    names = [y, *xs]
    rows = df.dropna(subset=[*names, first, second, cluster])
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    cells = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *products).collect()
    if not cells:
        return []
    levels = [sorted({c[k] for c in cells}) for k in (first, second)]
    place = [{v: i for i, v in enumerate(x)} for x in levels]
    k, a, b = len(xs), len(levels[0]), len(levels[1]) - 1  # the last level of the second effect is the reference
    size = k + a + b
    gram, rhs = np.zeros((size, size)), np.zeros(size)
    n, yy, sy = 0, 0.0, 0.0
    for c in cells:
        at = [k + place[0][c[first]]]
        if place[1][c[second]] < b:
            at.append(k + a + place[1][c[second]])
        n, yy, sy = n + c["n"], yy + c["p0_0"], sy + c["s0"]
        for i in range(1, k + 1):
            rhs[i - 1] += c[f"p0_{i}"]
            for j in range(i, k + 1):
                gram[i - 1, j - 1] += c[f"p{i}_{j}"]
                if i != j:
                    gram[j - 1, i - 1] += c[f"p{i}_{j}"]
            for t in at:
                gram[i - 1, t] += c[f"s{i}"]
                gram[t, i - 1] += c[f"s{i}"]
        for t in at:
            rhs[t] += c["s0"]
            for u in at:
                gram[t, u] += c["n"]
    inverse = np.linalg.pinv(gram)
    beta = inverse @ rhs
    rank = int(np.linalg.matrix_rank(gram))
    # Second pass: residual of each row, then sums of x * residual by cluster and effect level.
    fit = sum((F.lit(float(beta[i])) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    one = {v: float(beta[k + i]) for i, v in enumerate(levels[0])}
    two = {v: float(beta[k + a + i]) if i < b else 0.0 for i, v in enumerate(levels[1])}
    effect = [F.create_map(*(F.lit(z) for p in m.items() for z in p)) for m in (one, two)]
    e = F.col(y) - fit - effect[0][F.col(first)] - effect[1][F.col(second)]
    # Rows of the projection that takes scores to slopes.
    project = inverse[:k]
    first_map = [F.create_map(*(F.lit(z) for i, v in enumerate(levels[0]) for z in (v, float(project[q, k + i])))) for q in range(k)]
    second_map = [F.create_map(*(F.lit(z) for i, v in enumerate(levels[1]) for z in (v, float(project[q, k + a + i]) if i < b else 0.0))) for q in range(k)]
    weight = [sum((F.lit(float(project[q, i])) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0)) + first_map[q][F.col(first)] + second_map[q][F.col(second)] for q in range(k)]
    scored = rows.select(cluster, e.alias("__e"), *(w.alias(f"__w{q}") for q, w in enumerate(weight)))
    sums = scored.groupBy(cluster).agg(F.sum(F.col("__e") ** 2).alias("rss"), *(F.sum(F.col("__e") * F.col(f"__w{q}")).alias(f"g{q}") for q in range(k)))
    total = sums.agg(F.count(F.lit(1)).alias("g"), F.sum("rss").alias("rss"), *(F.sum(F.col(f"g{q}") ** 2).alias(f"v{q}") for q in range(k))).first()
    g = total["g"]
    factor = g / (g - 1) * (n - 1) / max(1, n - rank) if g > 1 else float("nan")
    # What is left of y within the effects alone.
    within = float(yy - rhs[k:] @ np.linalg.pinv(gram[k:, k:]) @ rhs[k:])
    out = []
    for q, x in enumerate(xs):
        se = math.sqrt(total[f"v{q}"] * factor) if factor == factor else float("nan")
        z = float(beta[q]) / se if se else float("nan")
        tss = yy - sy * sy / n
        out.append({"term": x, "estimate": float(beta[q]), "std_error": se, "statistic": z, "p_value": math.erfc(abs(z) / math.sqrt(2)) if z == z else float("nan"), "n": n, "r2": float(1 - total["rss"] / tss) if tss else float("nan"), "low": float(beta[q] - 1.96 * se), "high": float(beta[q] + 1.96 * se), "within_r2": float(1 - total["rss"] / within) if within > 0 else float("nan")})
    return out
