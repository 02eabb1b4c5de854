"""Staggered difference-in-differences by cell sums.

One self-join of the panel by firm gives outcome changes between pairs of years; their counts, sums and products by pair
and cohort are all that the estimates need, so what leaves the rows is bounded by years and cohorts. Cells of cohort g and
year t compare with the year before (t < g) or with g - 1; controls are the firms not treated by then, never treated ones
(cohort 0) included. With covariates, controls' changes are regressed on them and the treated are compared with the fit.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def did_sample(panel: DataFrame, firm: str, year: str, cohort: str, outcome: str, controls: list[str] | None = None, first_cohort: int = 0) -> DataFrame:
    """(firm, year, cohort, y, x0..): rows with everything known, cohort 0 or at least first_cohort. (firm, year) must be unique."""
    c = F.col(cohort)
    kept = panel.dropna(subset=[firm, year, cohort, outcome, *(controls or [])]).filter((c == 0) | (c >= first_cohort))
    return kept.select(F.col(firm).alias("firm"), F.col(year).alias("year"), c.alias("cohort"), F.col(outcome).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(controls or [])))


def sample_loss(panel: DataFrame, firm: str, year: str, cohort: str, outcome: str, controls: list[str] | None = None, first_cohort: int = 0) -> DataFrame:
    """(step, rows, firms): what is left after each of the conditions of did_sample, one pass for all."""
    known = lambda *cs: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cs))
    steps = [("all", F.lit(True)), ("keys", known(firm, year)), ("cohort", known(cohort)), ("outcome", known(outcome)), *([("controls", known(*controls))] if controls else []), ("first_cohort", (F.col(cohort) == 0) | (F.col(cohort) >= first_cohort))]
    held, ands = [], F.lit(True)
    for name, condition in steps:
        ands = ands & F.coalesce(condition, F.lit(False))
        held.append((name, ands))
    firms = panel.groupBy(firm).agg(*(F.count_if(c).alias(n) for n, c in held))
    sums = firms.agg(*(F.struct(F.lit(n).alias("step"), F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.count_if((F.col(n) > 0) & F.col(firm).isNotNull()).alias("firms")).alias(n) for n, _ in held))
    return sums.select(F.inline(F.array(*(n for n, _ in held))))


def changes(sample: DataFrame) -> DataFrame:
    """(firm, cohort, t, b, dy, x0..): change from an earlier year b of the same firm; covariates of the earlier year.

    Of the earlier years only those that a cell compares with are joined: the year before, and the year before each cohort's
    first that the firm is treated in or not yet treated by. The cohorts, at most one per year, are listed on the driver.
    """
    xs = [c for c in sample.columns if c.startswith("x")]
    cohorts = F.array(*(F.lit(r[0]) for r in sample.filter("cohort > 0").select("cohort").distinct().orderBy("cohort").collect())).cast("array<int>")
    own, t = F.col("cohort"), F.col("year")
    bases = F.transform(F.filter(cohorts, lambda g: (g <= t) & ((g == own) | (own == 0) | (own > t))), lambda g: g - 1)
    late = sample.select("firm", "cohort", t.alias("t"), F.col("y").alias("__y"), F.explode(F.array_distinct(F.concat(F.array((t - 1).cast("int")), bases))).alias("b"))
    early = sample.select("firm", t.cast("int").alias("b"), F.col("y").alias("__z"), *xs)
    return late.join(early, ["firm", "b"]).select("firm", "cohort", "t", "b", (F.col("__y") - F.col("__z")).alias("dy"), *xs)


def _cells(pairs: DataFrame) -> DataFrame:
    """Every change in the cells (g, t) it belongs to, with treated 1 or 0."""
    # With b = t - 1 a change serves g = t and, for pre-treatment, every later g; otherwise only g = b + 1.
    cohorts = pairs.filter("cohort > 0").select(F.col("cohort").alias("g")).distinct()
    cond = (F.col("g") == F.col("b") + 1) | ((F.col("b") == F.col("t") - 1) & (F.col("g") > F.col("t")))
    joined = pairs.join(F.broadcast(cohorts), cond)  # one row per cohort year
    treated = F.col("cohort") == F.col("g")
    control = ~treated & ((F.col("cohort") == 0) | (F.col("cohort") > F.col("t")))
    return joined.filter(treated | control).withColumn("treated", treated.cast("int"))


def att_gt(sample: DataFrame) -> DataFrame:
    """(g, t, n_treated, n_control, att, se) without covariates; cells without treated or control changes are left out.

    A row's cells are few (see _cells): sums are combined per task before the shuffle.
    """
    cells = _cells(changes(sample))
    arms = cells.groupBy("g", "t", "treated").agg(F.count(F.lit(1)).alias("n"), F.avg("dy").alias("m"), F.var_pop("dy").alias("v"))
    pick = lambda c, a: F.max(F.when(F.col("treated") == a, F.col(c)))
    wide = arms.groupBy("g", "t").agg(*(pick(c, a).alias(f"{c}{a}") for c in "nmv" for a in (0, 1))).filter("n0 is not null and n1 is not null")
    return wide.select("g", "t", F.col("n1").alias("n_treated"), F.col("n0").alias("n_control"), (F.col("m1") - F.col("m0")).alias("att"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("se"))


def by_cohort(cells: DataFrame) -> DataFrame:
    """Mean effect of each cohort over its treated years."""
    return cells.filter("t >= g").groupBy("g").agg(F.max("n_treated").alias("n_treated"), F.avg("att").alias("att"))


def overall(cohorts: DataFrame) -> DataFrame:
    """One row: the cohorts' effects weighted by their treated firms; null without a cohort."""
    return cohorts.agg(F.count(F.lit(1)).alias("cohorts"), F.sum("n_treated").alias("n_treated"), F.try_divide(F.sum(F.col("n_treated") * F.col("att")), F.sum("n_treated").cast("double")).alias("att"))


def by_event_time(cells: DataFrame, first: int = -4, last: int = 6) -> DataFrame:
    """Effect by years since treatment, cells weighted by their treated firms."""
    e = F.col("t") - F.col("g")
    rows = cells.withColumn("event_time", e).filter(e.between(first, last))
    return rows.groupBy("event_time").agg(F.sum("n_treated").alias("n_treated"), (F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for n in range(1, 1000):
        k = -n * (n - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def event_study(sample: DataFrame, first: int = -4, last: int = 6, level: float = 0.95, draws: int = 20_000, seed: int = 1) -> dict:
    """Dynamic effects with firm-clustered errors, uniform bands and the Wald test of the pre-treatment effects.

    Influences are summed per firm in Spark; only their cross products, event times squared, reach the driver. Bands use
    the simulated maximum of normal draws with that covariance.
    """
    pairs = changes(sample)
    cells = att_gt(sample).filter((F.col("t") - F.col("g")).between(first, last)).collect()
    times = sorted({r["t"] - r["g"] for r in cells})
    if not times:
        return {"effects": [], "wald": None}
    weight = {e: sum(r["n_treated"] for r in cells if r["t"] - r["g"] == e) for e in times}
    effect = {e: sum(r["att"] * r["n_treated"] for r in cells if r["t"] - r["g"] == e) / weight[e] for e in times}
    schema = "g int, t int, e int, n1 long, n0 long, w double"
    small = sample.sparkSession.createDataFrame([(r["g"], r["t"], r["t"] - r["g"], r["n_treated"], r["n_control"], r["n_treated"] / weight[r["t"] - r["g"]]) for r in cells], schema)
    rows = _cells(pairs).join(F.broadcast(small), ["g", "t"])  # one row per cell
    means = rows.groupBy("g", "t", "treated").agg(F.avg("dy").alias("m"))
    rows = rows.join(F.broadcast(means), ["g", "t", "treated"])
    part = F.col("w") * (F.col("dy") - F.col("m")) * F.when(F.col("treated") == 1, 1 / F.col("n1")).otherwise(-1 / F.col("n0"))
    firms = rows.groupBy("firm").agg(*(F.sum(F.when(F.col("e") == e, part).otherwise(0.0)).alias(f"i{k}") for k, e in enumerate(times)))
    k = len(times)
    sums = firms.agg(*(F.sum(F.col(f"i{a}") * F.col(f"i{b}")).alias(f"c{a}_{b}") for a in range(k) for b in range(a, k))).first()
    cov = np.array([[sums[f"c{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)], float)
    se = np.sqrt(np.diag(cov))
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(cov)
    normal = rng.standard_normal((draws, k)) @ (vectors * np.sqrt(np.clip(values, 0, None))).T
    critical = float(np.quantile(np.abs(normal / np.where(se > 0, se, np.inf)).max(axis=1), level))
    beta = np.array([effect[e] for e in times])
    pre = [i for i, e in enumerate(times) if e < -0]
    wald = None
    if pre:
        v = cov[np.ix_(pre, pre)]
        stat = float(beta[pre] @ np.linalg.pinv(v) @ beta[pre])
        wald = {"statistic": stat, "df": len(pre), "p_value": gamma_upper(len(pre) / 2, stat / 2)}
    effects = [{"event_time": e, "att": float(b), "se": float(s), "low": float(b - critical * s), "high": float(b + critical * s)} for e, b, s in zip(times, beta, se)]
    return {"effects": effects, "wald": wald, "critical": critical}


def att_gt_adjusted(sample: DataFrame) -> DataFrame:
    """(g, t, n_treated, n_control, att) with covariates by outcome regression.

    Products of covariates and changes are summed per cell and arm; one small least-squares problem per cell is solved on
    the driver. Cells with fewer controls than coefficients are left out.
    """
    xs = [c for c in sample.columns if c.startswith("x")]
    cells = _cells(changes(sample)).withColumn("one", F.lit(1.0))
    names = ["one", *xs]
    agg = [F.count(F.lit(1)).alias("n"), F.sum("dy").alias("y"), *(F.sum(a).alias(f"s_{a}") for a in names), *(F.sum(F.col(a) * F.col("dy")).alias(f"y_{a}") for a in names), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:])]
    arms: dict = {}
    for r in cells.groupBy("g", "t", "treated").agg(*agg).collect():
        arms.setdefault((r["g"], r["t"]), {})[r["treated"]] = r
    out = []
    for (g, t), arm in sorted(arms.items()):
        if 0 not in arm or 1 not in arm or arm[0]["n"] <= len(names):
            continue
        c, one = arm[0], arm[1]
        gram = np.array([[c[f"p_{a}_{b}"] if names.index(a) <= names.index(b) else c[f"p_{b}_{a}"] for b in names] for a in names])
        beta = np.linalg.pinv(gram) @ np.array([c[f"y_{a}"] for a in names])
        fit = sum(b * one[f"s_{a}"] for a, b in zip(names, beta)) / one["n"]
        out.append((g, t, one["n"], c["n"], float(one["y"] / one["n"] - fit)))
    return sample.sparkSession.createDataFrame(out, "g int, t int, n_treated long, n_control long, att double")


def residualized(rows: DataFrame, xs: list[str]) -> DataFrame:
    """rows (firm, year, d, f, y and controls) with y less what the controls explain.

    For each baseline dose changes of y from one year to the next are regressed on those of the controls, year by year
    demeaned, over firms that have not changed yet. Sums of products per dose reach the driver, one small system each.
    """
    w = Window.partitionBy("firm").orderBy("year")
    step = lambda c: F.when(F.lag("year").over(w) == F.col("year") - 1, F.col(c) - F.lag(c).over(w))
    names = ["y", *xs]
    diff = rows.select("d", "year", "f", *(step(c).alias(f"__{c}") for c in names)).filter(F.col("f").isNull() | (F.col("year") < F.col("f"))).dropna(subset=[f"__{c}" for c in names])
    means = diff.groupBy("d", "year").agg(*(F.avg(f"__{c}").alias(f"__m{c}") for c in names))
    flat = diff.join(means, ["d", "year"]).select("d", *((F.col(f"__{c}") - F.col(f"__m{c}")).alias(c) for c in names))
    sums = flat.groupBy("d").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)).collect()
    k = len(names)
    slopes = [(r["d"], [float(v) for v in np.linalg.pinv(np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(1, k)] for i in range(1, k)])) @ np.array([r[f"p_0_{j}"] for j in range(1, k)])]) for r in sums]
    kind = dict(rows.dtypes)["d"]
    theta = rows.sparkSession.createDataFrame(slopes, f"d {kind}, __s array<double>")
    fit = sum((F.coalesce(F.col("__s")[i], F.lit(0.0)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return rows.join(F.broadcast(theta), "d", "left").withColumn("y", F.col("y") - fit).drop("__s")  # one row per dose


def switcher_cells(panel: DataFrame, firm: str, year: str, dose: str, outcome: str, effects: int, placebos: int, controls: list[str] | None = None, strata: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(estimates, influence, rows): kind, step, n_switchers, did; firm, kind, step, influence; and the rows used.

    A switcher's change is compared with the mean of its cell: firms of the same baseline dose, and strata if given, over the
    same years that have not changed by the later one.
    """
    from panelwright.operators.paths import first_switch

    xs, zs = [f"__x{i}" for i in range(len(controls or []))], [f"__z{i}" for i in range(len(strata or []))]
    rows = panel.dropna(subset=[firm, year, dose, outcome, *(controls or []), *(strata or [])])
    rows = rows.select(F.col(firm).alias("firm"), F.col(year).alias("year"), F.col(dose).alias("dose"), F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(x) for c, x in zip(controls or [], xs)), *(F.col(c).alias(z) for c, z in zip(strata or [], zs)))
    info = first_switch(rows, "firm", "year", "dose").select("firm", F.col("initial").alias("d"), F.col("first_switch_year").alias("f"), F.col("direction").alias("s"))
    rows = rows.join(info, "firm")
    if xs:
        rows = residualized(rows, xs)
    reach = max(effects, placebos)
    late = rows.select("firm", "d", "f", "s", *zs, F.col("year").alias("t"), F.col("y").alias("__y"), F.explode(F.sequence(F.col("year") - reach, F.col("year") - 1)).alias("b"))
    early = rows.select("firm", F.col("year").alias("b"), F.col("y").alias("__z"))
    pairs = late.join(early, ["firm", "b"]).withColumn("dy", F.col("__y") - F.col("__z")).withColumn("step", (F.col("t") - F.col("b")).cast("int"))
    cell = ["d", *zs, "b", "t"]
    never = F.col("f").isNull()
    # Of a switcher the pair that begins (effect) or ends (placebo) at F - 1; a placebo's controls, too, must not have changed by the year of comparison after F - 1.
    arms = {"effect": (effects, F.col("b") == F.col("f") - 1, never | (F.col("f") > F.col("t")), 1), "placebo": (placebos, F.col("t") == F.col("f") - 1, never | (F.col("f") > F.col("t") + F.col("step")), -1)}
    estimates, parts = [], []
    for kind, (steps, switch, still, sign) in arms.items():
        near = pairs.filter(F.col("step") <= steps)
        control = near.filter(still)
        means = control.groupBy(*cell).agg(F.avg("dy").alias("c"), F.count(F.lit(1)).alias("n0"))
        moved = near.filter(switch).join(means, cell).withColumn("v", sign * F.col("s") * (F.col("dy") - F.col("c")))
        found = moved.groupBy("step").agg(F.count(F.lit(1)).alias("n_switchers"), F.avg("v").alias("did"))
        estimates.append(found.select(F.lit(kind).alias("kind"), "step", "n_switchers", "did"))
        small = F.broadcast(found)  # one row per step
        own = moved.join(small, "step").select("firm", "step", ((F.col("v") - F.col("did")) / F.col("n_switchers")).alias("i"))
        weight = moved.groupBy(*cell).agg((sign * F.sum("s")).alias("__s"))
        other = control.join(means, cell).join(weight, cell).join(small, "step").select("firm", "step", (-F.col("__s") * (F.col("dy") - F.col("c")) / (F.col("n0") * F.col("n_switchers"))).alias("i"))
        parts.append(own.unionByName(other).groupBy("firm", "step").agg(F.sum("i").alias("influence")).select("firm", F.lit(kind).alias("kind"), "step", "influence"))
    return estimates[0].unionByName(estimates[1]), parts[0].unionByName(parts[1]), rows


def switcher_effects(panel: DataFrame, firm: str, year: str, dose: str, outcome: str, effects: int = 4, placebos: int = 4, controls: list[str] | None = None, strata: list[str] | None = None) -> DataFrame:
    """(kind, step, n_switchers, did, se, dose_change, normalized): effects of first changes of an ordinal dose.

    A switcher with baseline dose d and first change in year F is compared, from F - 1 on over step years (for a placebo
    back to F - 1 - step), with firms of the same baseline that have not changed by the later year; a lower dose counts
    with the opposite sign. did is the mean over switchers, se its error by firm, dose_change the mean cumulative absolute
    change of the dose. controls are taken out by residualized, whose own error se leaves out; strata split the comparisons.
    Rows with a null in any column used are left out; (firm, year) must be unique.
    """
    estimates, influence, rows = switcher_cells(panel, firm, year, dose, outcome, effects, placebos, controls, strata)
    errors = influence.groupBy("kind", "step").agg(F.sqrt(F.sum(F.col("influence") ** 2)).alias("se"))
    # Cumulative change of dose from F to F - 1 + step.
    steps = rows.filter("f is not null").select("firm", (F.col("year") - F.col("f") + 1).alias("k"), F.abs(F.col("dose") - F.col("d")).alias("c")).filter(F.col("k").between(1, effects))
    running = Window.partitionBy("firm").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    change = steps.withColumn("c", F.sum("c").over(running)).groupBy(F.col("k").cast("int").alias("step")).agg(F.avg("c").alias("dose_change")).withColumn("kind", F.lit("effect"))
    out = estimates.join(errors, ["kind", "step"]).join(change, ["kind", "step"], "left")
    return out.select("kind", "step", "n_switchers", "did", "se", "dose_change", F.try_divide("did", "dose_change").alias("normalized"))


def equal_effects(panel: DataFrame, firm: str, year: str, dose: str, outcome: str, effects: int = 4, **options) -> dict | None:
    """Wald tests that all effects are equal and that all placebos are zero, by the firms' influences: {name: statistic, df, p_value}.

    Cross products of the steps' influences reach the driver, their number squared.
    """
    estimates, influence, _ = switcher_cells(panel, firm, year, dose, outcome, effects, options.pop("placebos", effects), **options)
    found = {(r["kind"], r["step"]): r["did"] for r in estimates.collect()}
    names = sorted(found)
    if not names:
        return None
    firms = influence.groupBy("firm").agg(*(F.sum(F.when((F.col("kind") == k) & (F.col("step") == s), F.col("influence")).otherwise(0.0)).alias(f"i{n}") for n, (k, s) in enumerate(names)))
    sums = firms.agg(*(F.sum(F.col(f"i{a}") * F.col(f"i{b}")).alias(f"c{a}_{b}") for a in range(len(names)) for b in range(a, len(names)))).first()
    out = {}
    for name, kind in (("equal_effects", "effect"), ("no_placebo", "placebo")):
        at = [n for n, (k, _) in enumerate(names) if k == kind]
        if len(at) < 1 + (kind == "effect"):
            continue
        beta = np.array([found[names[n]] for n in at])
        v = np.array([[sums[f"c{min(a, b)}_{max(a, b)}"] for b in at] for a in at], float)
        r = np.eye(len(at))[1:] - np.eye(len(at))[:1] if kind == "effect" else np.eye(len(at))
        statistic = float((r @ beta) @ np.linalg.pinv(r @ v @ r.T) @ (r @ beta))
        out[name] = {"statistic": statistic, "df": len(r), "p_value": gamma_upper(len(r) / 2, statistic / 2)}
    return out or None
