"""Queries of estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.estimators import did as D
from panelwright.estimators import doubly_robust as B
from panelwright.estimators import lpm as L
from panelwright.plans.common import SQL_UNIQUE, Registry, rounded, unique_panel

registry = Registry()
add = registry.add

_SAMPLE = f"""{SQL_UNIQUE}, s AS (SELECT firm, year, ai_adoption_year AS cohort, ln(total_assets) AS y FROM (SELECT *, row_number() OVER (PARTITION BY firm, year ORDER BY panel_id) AS q FROM uniq WHERE total_assets > 0 AND year IS NOT NULL AND ai_adoption_year IS NOT NULL) WHERE q = 1 AND (ai_adoption_year = 0 OR ai_adoption_year >= 2014)),
p AS (SELECT a.firm, a.cohort, a.year AS t, b.year AS b, a.y - b.y AS dy FROM s a JOIN s b ON a.firm = b.firm AND b.year < a.year), gs AS (SELECT DISTINCT cohort AS g FROM p WHERE cohort > 0),
c AS (SELECT g, t, dy, cohort = g AS tr FROM p JOIN gs ON g = b + 1 OR (b = t - 1 AND g > t) WHERE cohort = g OR cohort = 0 OR cohort > t),
cells AS (SELECT g, t, count(*) FILTER (WHERE tr) AS n_treated, count(*) FILTER (WHERE NOT tr) AS n_control, avg(dy) FILTER (WHERE tr) - avg(dy) FILTER (WHERE NOT tr) AS att,
    sqrt(var_pop(dy) FILTER (WHERE tr) / count(*) FILTER (WHERE tr) + var_pop(dy) FILTER (WHERE NOT tr) / count(*) FILTER (WHERE NOT tr)) AS se FROM c GROUP BY g, t HAVING count(*) FILTER (WHERE tr) > 0 AND count(*) FILTER (WHERE NOT tr) > 0)"""


def _sample(spark, d, controls=None):
    from panelwright.operators.panel import best_row

    rows = unique_panel(spark, d).filter("total_assets > 0 and year is not null and ai_adoption_year is not null")
    rows = best_row(rows, ["firm", "year"], [F.col("panel_id").asc()]).withColumn("log_assets", F.ln("total_assets"))
    return D.did_sample(rows, "firm", "year", "ai_adoption_year", "log_assets", controls, 2014)


@add(f"WITH {_SAMPLE} SELECT CAST(g AS INT) AS g, CAST(t AS INT) AS t, n_treated, n_control, round(att, 6) AS att, round(se, 6) AS se FROM cells")
def att_gt_unconditional(spark, d):
    return rounded(D.att_gt(_sample(spark, d)))


@add(f"WITH {_SAMPLE} SELECT CAST(g AS INT) AS g, max(n_treated) AS n_treated, round(avg(att), 6) AS att FROM cells WHERE t >= g GROUP BY g")
def att_group(spark, d):
    return rounded(D.by_cohort(D.att_gt(_sample(spark, d))))


@add(f"WITH {_SAMPLE} SELECT CAST(t - g AS INT) AS event_time, CAST(sum(n_treated) AS BIGINT) AS n_treated, round(sum(att * n_treated) / sum(n_treated), 6) AS att FROM cells WHERE t - g BETWEEN -4 AND 6 GROUP BY t - g")
def att_dynamic(spark, d):
    return rounded(D.by_event_time(D.att_gt(_sample(spark, d))))


@add()
def att_dynamic_bands(spark, d):
    """Firm-clustered errors and uniform bands; tested against a NumPy derivation."""
    effects = D.event_study(_sample(spark, d))["effects"]
    return spark.createDataFrame([tuple(e.values()) for e in effects], "event_time int, att double, se double, low double, high double")


_WITH_X = _SAMPLE.replace("ln(total_assets) AS y FROM", "ln(total_assets) AS y, che AS x FROM").replace("WHERE q = 1 AND", "WHERE q = 1 AND che IS NOT NULL AND").replace("a.y - b.y AS dy FROM", "a.y - b.y AS dy, b.x FROM").replace("SELECT g, t, dy, cohort = g AS tr", "SELECT g, t, dy, x, cohort = g AS tr")


@add(f"""WITH {_WITH_X}, f AS (SELECT g, t, count(*) FILTER (WHERE tr) AS n_treated, count(*) FILTER (WHERE NOT tr) AS n_control, avg(dy) FILTER (WHERE tr) AS d1, avg(x) FILTER (WHERE tr) AS x1, avg(dy) FILTER (WHERE NOT tr) AS d0, avg(x) FILTER (WHERE NOT tr) AS x0,
    covar_pop(dy, x) FILTER (WHERE NOT tr) AS c, var_pop(x) FILTER (WHERE NOT tr) AS v FROM c GROUP BY g, t)
    SELECT CAST(g AS INT) AS g, CAST(t AS INT) AS t, n_treated, n_control, round(d1 - d0 - c / v * (x1 - x0), 6) AS att FROM f WHERE n_treated > 0 AND n_control > 2 AND v > 0""")
def att_gt_adjusted(spark, d):
    """Outcome regression on a covariate of the earlier year."""
    return rounded(D.att_gt_adjusted(_sample(spark, d, ["che"])))


@add(f"WITH {_SAMPLE} SELECT CAST(g AS INT) AS g, CAST(t AS INT) AS t, n_treated, n_control, round(att, 6) AS att, round(se, 6) AS se FROM cells WHERE n_control > 1")
def att_gt_robust(spark, d):
    """Without covariates the doubly robust estimate and its error are those of mean changes."""
    return rounded(B.att_gt_robust(_sample(spark, d))[0])


@add()
def att_gt_robust_adjusted(spark, d):
    """Doubly robust with a covariate; tested against NumPy."""
    return B.att_gt_robust(_sample(spark, d, ["che"]))[0]


@add()
def att_robust_bootstrap(spark, d):
    """Effects by event time with 1,000 multiplier draws; errors tested against the analytic ones."""
    effects = B.dynamic_effects(_sample(spark, d, ["che"]))["effects"]
    return spark.createDataFrame([tuple(e.values()) for e in effects], "event_time int, att double, se double, low double, high double")


_DOSE = f"""{SQL_UNIQUE}, r AS (SELECT firm, fyear AS year, ai_adopted + CAST(coalesce(datadate > first_ai3_filing_date, FALSE) AS INT) AS dose, ln(total_assets) AS y FROM uniq WHERE ai_adopted IS NOT NULL AND total_assets > 0), i AS (SELECT *, first_value(dose) OVER (PARTITION BY firm ORDER BY year) AS d FROM r),
k AS (SELECT firm, min(d) AS d, min(CASE WHEN dose <> d THEN year END) AS f FROM i GROUP BY firm), n AS (SELECT k.*, sign(r.dose - k.d) AS s FROM k LEFT JOIN r ON r.firm = k.firm AND r.year = k.f),
p AS (SELECT n.firm, d, f, s, a.year AS t, b.year AS b, a.y - b.y AS dy FROM r a JOIN r b ON a.firm = b.firm AND a.year > b.year AND a.year - b.year <= 4 JOIN n ON n.firm = a.firm),
e AS (SELECT d, b, t, s, t - b AS step, count(*) AS n, avg(dy) AS m FROM p WHERE b = f - 1 GROUP BY ALL), c AS (SELECT d, b, t, avg(dy) AS c FROM p WHERE f IS NULL OR f > t GROUP BY ALL),
q AS (SELECT d, b, t, s, t - b AS step, count(*) AS n, avg(dy) AS m FROM p WHERE t = f - 1 GROUP BY ALL), u AS (SELECT d, b, t, avg(dy) AS c FROM p WHERE f IS NULL OR f > t + t - b GROUP BY ALL)"""


@add(f"""WITH {_DOSE} SELECT 'effect' AS kind, CAST(step AS INT) AS step, CAST(sum(n) AS BIGINT) AS n_switchers, round(sum(s * n * (m - c)) / sum(n), 6) AS did FROM e JOIN c USING (d, b, t) GROUP BY step
    UNION ALL SELECT 'placebo', CAST(step AS INT), CAST(sum(n) AS BIGINT), round(sum(-s * n * (m - c)) / sum(n), 6) FROM q JOIN u USING (d, b, t) GROUP BY step""")
def did_l_unconditional(spark, d):
    rows = unique_panel(spark, d).filter("ai_adopted is not null and total_assets > 0").select("firm", "fyear", (F.col("ai_adopted") + F.coalesce(F.col("datadate") > F.col("first_ai3_filing_date"), F.lit(False)).cast("int")).alias("dose"), F.ln("total_assets").alias("y"))
    return rounded(D.switcher_effects(rows, "firm", "fyear", "dose", "y").select("kind", "step", "n_switchers", "did"))


def _doses(spark, d):
    rows = unique_panel(spark, d).filter("ai_adopted is not null and total_assets > 0")
    return rows.select("firm", "fyear", (F.col("ai_adopted") + F.coalesce(F.col("datadate") > F.col("first_ai3_filing_date"), F.lit(False)).cast("int")).alias("dose"), F.ln("total_assets").alias("y"), F.coalesce("che", F.lit(0.0)).alias("che"), F.coalesce(F.substring("naics2", 1, 1), F.lit("")).alias("sector"))


@add()
def did_l_errors(spark, d):
    """With a control and errors by firm; tested against resampled firms and least squares."""
    return D.switcher_effects(_doses(spark, d), "firm", "fyear", "dose", "y", controls=["che"])


_STRATA = _DOSE.replace("ln(total_assets) AS y FROM", "ln(total_assets) AS y, coalesce(substr(naics2, 1, 1), '') AS z FROM").replace("b.year AS b, a.y - b.y AS dy", "b.year AS b, a.y - b.y AS dy, a.z AS z").replace("SELECT d, b, t,", "SELECT d, z, b, t,")


@add(f"""WITH {_STRATA} SELECT 'effect' AS kind, CAST(step AS INT) AS step, CAST(sum(n) AS BIGINT) AS n_switchers, round(sum(s * n * (m - c)) / sum(n), 6) AS did FROM e JOIN c USING (d, z, b, t) GROUP BY step
    UNION ALL SELECT 'placebo', CAST(step AS INT), CAST(sum(n) AS BIGINT), round(sum(-s * n * (m - c)) / sum(n), 6) FROM q JOIN u USING (d, z, b, t) GROUP BY step""")
def did_l_strata(spark, d):
    return rounded(D.switcher_effects(_doses(spark, d), "firm", "fyear", "dose", "y", strata=["sector"]).select("kind", "step", "n_switchers", "did"))


@add()
def did_l_tests(spark, d):
    """Equality of effects and absence of placebo effects; the tests' parts are checked in pytest."""
    tests = D.equal_effects(_doses(spark, d), "firm", "fyear", "dose", "y") or {}
    return spark.createDataFrame([(k, *v.values()) for k, v in tests.items()], "test string, statistic double, df int, p_value double")


@add("""WITH k AS (SELECT naics2, CAST(ai_adopted AS DOUBLE) AS y, sale / 1000 AS x FROM analysis_panel WHERE ai_adopted IS NOT NULL AND sale IS NOT NULL AND naics2 IS NOT NULL), m AS (SELECT *, y - avg(y) OVER (PARTITION BY naics2) AS yy, x - avg(x) OVER (PARTITION BY naics2) AS xx FROM k)
    SELECT count(*) AS n, round(sum(xx * yy) / nullif(sum(xx * xx), 0), 6) AS slope FROM m""")
def fwl_one_fe(spark, d):
    from panelwright.plans.common import table

    rows = table(spark, d, "analysis_panel").select("naics2", F.col("ai_adopted").cast("double").alias("y"), (F.col("sale") / 1000).alias("x"))
    return rounded(L.one_effect_slope(rows, "y", "x", "naics2"))


@add()
def lpm_two_fe(spark, d):
    """Two fixed effects and clustered errors; tested against NumPy dummies."""
    rows = L.risk_set(unique_panel(spark, d).filter("has_ai_history"), "year", "ai_adoption_year", 2016).select("firm", "year", "naics3", F.col("event").cast("double").alias("event"), (F.col("sale") / 1000).alias("sale"), (F.col("total_assets") / 1000).alias("assets"))
    out = L.two_effects(rows, "event", ["sale", "assets"], "year", "naics3", "firm")
    return spark.createDataFrame([tuple(r.values()) for r in out], "term string, estimate double, std_error double, statistic double, p_value double, n long, r2 double, low double, high double, within_r2 double")


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
