"""Effects of first changes of a dose: errors, controls, strata and tests."""

import numpy as np
import pytest

from panelwright.estimators import did as D


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    rows = []
    for f in range(150):
        switch = rng.choice([0, 2004, 2005, 2007])
        base, x = int(rng.integers(0, 2)), rng.normal()
        up = 1 if base == 0 or rng.random() < 0.5 else -1
        level = 0.0
        for t in range(2000, 2011):
            x += rng.normal()
            level += rng.normal() * 0.3
            on = bool(switch) and t >= switch
            rows.append((f"f{f}", t, int(base + up * on), float(level + 0.8 * x + on * up * 1.0), float(x), "ab"[f % 2]))
    return rows


SCHEMA = "f string, t int, dose int, y double, x double, z string"


def effects(spark, rows, **options):
    out = D.switcher_effects(spark.createDataFrame(rows, SCHEMA), "f", "t", "dose", "y", 3, 2, **options)
    return {(r["kind"], r["step"]): r for r in out.collect()}


def plain(rows, steps=3):
    """Effects by loops."""
    firms: dict = {}
    for f, t, d, y, *_ in rows:
        firms.setdefault(f, {})[t] = (d, y)
    info = {f: (v[min(v)][0], min((t for t in v if v[t][0] != v[min(v)][0]), default=None)) for f, v in firms.items()}
    out = {}
    for step in range(1, steps + 1):
        values = []
        for f, (d, s) in info.items():
            if s and s - 1 in firms[f] and s - 1 + step in firms[f]:
                b, t = s - 1, s - 1 + step
                control = [firms[g][t][1] - firms[g][b][1] for g, (e, u) in info.items() if e == d and (u is None or u > t)]
                if control:
                    values.append(np.sign(firms[f][s][0] - d) * (firms[f][t][1] - firms[f][b][1] - np.mean(control)))
        out[step] = np.mean(values)
    return out


def test_effects_and_errors(spark, data):
    got = effects(spark, data)
    for step, v in plain(data).items():
        assert got["effect", step]["did"] == pytest.approx(v, abs=1e-9)
    rng, by_firm = np.random.default_rng(1), {}
    for r in data:
        by_firm.setdefault(r[0], []).append(r)
    names = sorted(by_firm)
    draws = [plain([(f"{n}#{i}", *r[1:]) for i, n in enumerate(rng.choice(names, len(names))) for r in by_firm[n]], 1)[1] for _ in range(150)]
    assert got["effect", 1]["se"] == pytest.approx(np.std(draws), rel=0.25)


def test_controls_take_out_what_they_explain(spark, data):
    got, raw = effects(spark, data, controls=["x"]), effects(spark, data)
    assert got["effect", 1]["did"] == pytest.approx(1.0, abs=0.2) and got["effect", 1]["se"] < 0.6 * raw["effect", 1]["se"]
    exact = [(f, t, d, 5.0 * x + t, x, z) for f, t, d, _, x, z in data]
    assert all(abs(r["did"]) < 1e-8 for r in effects(spark, exact, controls=["x"]).values())


def test_strata_are_compared_apart(spark, data):
    shifted = [(f, t, d, y + (t * 10 if z == "a" else 0), x, z) for f, t, d, y, x, z in data]
    one, two = effects(spark, data, strata=["z"]), effects(spark, shifted, strata=["z"])
    assert all(one[k]["did"] == pytest.approx(two[k]["did"], abs=1e-6) for k in one)


def test_equal_effects(spark, data):
    got = D.equal_effects(spark.createDataFrame(data, SCHEMA), "f", "t", "dose", "y", 3, placebos=2)
    assert got["equal_effects"]["df"] == 2 and got["no_placebo"]["df"] == 2 and all(v["p_value"] > 0.001 for v in got.values())
    later = [(f, t, d, y + (3.0 * (t - 2003) if d != base[f] else 0), x, z) for base in [{r[0]: r[2] for r in reversed(data)}] for f, t, d, y, x, z in data]
    assert D.equal_effects(spark.createDataFrame(later, SCHEMA), "f", "t", "dose", "y", 3)["equal_effects"]["p_value"] < 0.01
    assert D.equal_effects(spark.createDataFrame([], SCHEMA), "f", "t", "dose", "y", 3) is None
