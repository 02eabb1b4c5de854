"""Doubly robust estimates against NumPy, and bootstrap errors against analytic ones."""

import numpy as np
import pytest

from panelwright.estimators import did as D
from panelwright.estimators import doubly_robust as B


@pytest.fixture(scope="module")
def panel(spark):
    """Firms whose treatment and growth both depend on a covariate; the effect is 1.5."""
    rng = np.random.default_rng(4)
    data = []
    for f in range(240):
        x = float(rng.normal())
        g = 2004 if rng.random() < 1 / (1 + np.exp(0.7 - 0.8 * x)) else [0, 2006][rng.random() < 0.4]
        for t in range(2001, 2009):
            if rng.random() < 0.95:
                data.append((f"f{f}", t, g, float(0.4 * x * (t - 2000) + 1.5 * (g > 0 and t >= g) + rng.normal()), x))
    return data, D.did_sample(spark.createDataFrame(data, "f string, t int, g int, y double, x double"), "f", "t", "g", "y", ["x"])


def robust(data, g, t):
    """Estimate and error of one cell, all in arrays."""
    b = t - 1 if t < g else g - 1
    at = {(r[0], r[1]): r for r in data}
    rows = [(float(at[f, t][2] == g), at[f, t][3] - at[f, b][3], at[f, b][4]) for f in sorted({r[0] for r in data}) if (f, t) in at and (f, b) in at and (at[f, t][2] in (g, 0) or at[f, t][2] > t)]
    d, dy, x = np.array(rows).T
    z = np.c_[np.ones(len(d)), x]
    beta = np.linalg.lstsq(z[d == 0], dy[d == 0], rcond=None)[0]
    gamma = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ gamma))
        gamma += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (d - p))
    p, r = 1 / (1 + np.exp(-z @ gamma)), dy - z @ beta
    w, n = p * (1 - d) / (1 - p), len(d)
    e1, e0 = (d * r).sum() / d.sum(), (w * r).sum() / w.sum()
    ols = ((1 - d) * r)[:, None] * z @ np.linalg.inv((z * (1 - d)[:, None]).T @ z / n)
    ps = (d - p)[:, None] * z @ np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z / n)
    treat = (d * (r - e1) - ols @ (d[:, None] * z).mean(0)) / d.mean()
    control = (w * (r - e0) + ps @ ((w * (r - e0))[:, None] * z).mean(0) - ols @ (w[:, None] * z).mean(0)) / w.mean()
    return e1 - e0, np.sqrt(((treat - control) ** 2).sum()) / n, int(d.sum()), int(n - d.sum())


def test_cells_equal_arrays(panel):
    data, sample = panel
    cells = {(r["g"], r["t"]): r for r in B.att_gt_robust(sample)[0].collect()}
    assert len(cells) == 14
    for (g, t), r in cells.items():
        att, se, n1, n0 = robust(data, g, t)
        assert (r["n_treated"], r["n_control"]) == (n1, n0) and r["att"] == pytest.approx(att, abs=1e-8) and r["se"] == pytest.approx(se, rel=1e-6)


def test_without_covariates(panel):
    _, sample = panel
    plain = sample.drop("x0")
    want = {(r["g"], r["t"]): (r["att"], r["se"]) for r in D.att_gt(plain).collect()}
    for r in B.att_gt_robust(plain)[0].collect():
        assert (r["att"], r["se"]) == pytest.approx(want[r["g"], r["t"]], rel=1e-6)


def test_bootstrap(panel):
    _, sample = panel
    found = B.dynamic_effects(sample, draws=2000)
    cells, influence = B.att_gt_robust(sample)
    (cell,) = [r for r in cells.collect() if (r["g"], r["t"]) == (2004, 2004)]
    dev = B.bootstrap(influence, {"a": {(2004, 2004): 1.0}}, 2000)["a"]
    assert dev.std() == pytest.approx(cell["se"], rel=0.1) and (dev == B.bootstrap(influence.repartition(5), {"a": {(2004, 2004): 1.0}}, 2000)["a"]).mean() > 0
    assert 2.2 < found["critical"] < 3.4 and found["overall"]["att"] == pytest.approx(1.5, abs=0.35)
    assert found["wald"]["p_value"] > 0.001 and [e["event_time"] for e in found["effects"]] == list(range(-4, 5))


def test_nothing(spark):
    none = spark.createDataFrame([], "firm string, year int, cohort int, y double, x0 double")
    assert B.att_gt_robust(none)[0].count() == 0 and B.dynamic_effects(none)["effects"] == []
