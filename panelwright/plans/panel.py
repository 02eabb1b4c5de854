"""Queries on firm-year panels, filings by period and treatment."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.functions.keys import firm_key
from panelwright.operators import contracts as C
from panelwright.operators import panel as P
from panelwright.operators import paths as H
from panelwright.operators import treatment as R
from panelwright.operators.manifest import dense_index
from panelwright.plans.common import MEASURES, SQL_FILINGS, SQL_PANEL, SQL_UNIQUE, Registry, filings, panel, rounded, sql_key, table, unique_panel

registry = Registry()
add = registry.add


@add(f"WITH {SQL_UNIQUE} SELECT firm, fyear, panel_id, n_missing FROM uniq")
def best_row_dedupe(spark, d):
    return unique_panel(spark, d).select("firm", "fyear", "panel_id", "n_missing")


@add(f"""WITH {SQL_PANEL} SELECT panel_id FROM panel WHERE indfmt = 'INDL' AND consol = 'C' AND gvkey IS NOT NULL AND datadate IS NOT NULL AND fyear BETWEEN 2014 AND 2025
    AND total_assets > 0 AND sale >= 0 AND naics IS NOT NULL AND firm IS NOT NULL""")
def sample_filter(spark, d):
    keep = "indfmt = 'INDL' and consol = 'C' and gvkey is not null and datadate is not null and fyear between 2014 and 2025 and total_assets > 0 and sale >= 0 and naics is not null and firm is not null"
    return panel(spark, d).filter(keep).select("panel_id")


@add(f"WITH {SQL_UNIQUE} SELECT firm, fyear FROM uniq WHERE year BETWEEN 2015 AND 2025 AND exchg IN (11, 12, 14, 17, 21)")
def final_sample(spark, d):
    rows = unique_panel(spark, d).filter(F.col("year").between(2015, 2025) & X.is_in(F.col("exchg"), [11, 12, 14, 17, 21]))
    return rows.select("firm", "fyear")


@add(f"WITH {SQL_UNIQUE} SELECT firm, fyear FROM uniq WHERE coalesce(has_ai_history, FALSE) AND ai_adopted IS NOT NULL")
def causal_subset(spark, d):
    return unique_panel(spark, d).filter(F.coalesce("has_ai_history", F.lit(False)) & F.col("ai_adopted").isNotNull()).select("firm", "fyear")


@add(f"""WITH {SQL_UNIQUE} SELECT firm, fyear, CAST(lag(fyear) OVER w AS INT) AS lag_source_fyear, coalesce(fyear = lag(fyear) OVER w + 1, FALSE) AS lag_is_consecutive,
    CASE WHEN fyear = lag(fyear) OVER w + 1 THEN lag(total_assets) OVER w END AS total_assets_l1, CASE WHEN fyear = lag(fyear) OVER w + 1 THEN lag(sale) OVER w END AS sale_l1
    FROM uniq WINDOW w AS (PARTITION BY firm ORDER BY fyear)""")
def consecutive_lags(spark, d):
    rows = P.consecutive_lags(unique_panel(spark, d), "firm", "fyear", ["total_assets", "sale"])
    return rows.select("firm", "fyear", "lag_source_fyear", "lag_is_consecutive", "total_assets_l1", "sale_l1")


@add("""SELECT panel_id, CASE WHEN x.sale IS NOT NULL THEN least(greatest(x.sale, b.sl), b.sh) END AS sale_w, CASE WHEN x.ni IS NOT NULL THEN least(greatest(x.ni, b.nl), b.nh) END AS ni_w
    FROM analysis_panel x, (SELECT quantile_cont(sale, 0.01) AS sl, quantile_cont(sale, 0.99) AS sh, quantile_cont(ni, 0.01) AS nl, quantile_cont(ni, 0.99) AS nh FROM analysis_panel) b""")
def winsorized_columns(spark, d):
    return P.winsorize(table(spark, d, "analysis_panel"), ["sale", "ni"]).select("panel_id", "sale_w", "ni_w")


def _ratio(n, m):
    return f"CASE WHEN {m} > 0 THEN ({n}) / {m} END"


_LAG = "CASE WHEN fyear = lag(fyear) OVER w + 1 THEN lag({0}) OVER w END"


@add(f"""WITH {SQL_UNIQUE}, one AS (SELECT firm, fyear, total_assets AS ta, xrd, capx, emp, sale, oibdp, csho * prcc_f AS market_cap, dltt AS total_debt,
        CASE WHEN fyear >= first_compustat_fyear THEN CAST(fyear - first_compustat_fyear AS INT) END AS firm_age,
        CASE WHEN total_assets > 0 THEN ln(total_assets) END AS log_at, {_ratio('dltt', 'total_assets')} AS leverage, {_ratio('che', 'total_assets')} AS cash_ratio,
        {_ratio('ni', 'total_assets')} AS roa, {_ratio('oibdp', 'sale')} AS markup, CASE WHEN sale > 0 AND emp > 0 THEN sale / emp END AS labor_productivity,
        oibdp / nullif(total_assets, 0) AS operating_profit, xrd IS NOT NULL AS rd_reporter FROM uniq),
    two AS (SELECT *, {_LAG.format('ta')} AS at_l1, {_LAG.format('roa')} AS roa_l1 FROM one WINDOW w AS (PARTITION BY firm ORDER BY fyear))
    SELECT firm, fyear, firm_age, rd_reporter, round(log_at, 6) AS log_at, round(leverage, 6) AS leverage, round(cash_ratio, 6) AS cash_ratio, round(roa, 6) AS roa, round(markup, 6) AS markup,
        round(labor_productivity, 6) AS labor_productivity, round(operating_profit, 6) AS operating_profit, round({_ratio('market_cap + total_debt', 'ta')}, 6) AS tobins_q, round(roa_l1, 6) AS roa_l1,
        round({_ratio('ta - at_l1', 'at_l1')}, 6) AS asset_growth_y, round({_ratio('xrd', 'at_l1')}, 6) AS rd_intensity_y,
        round(CASE WHEN xrd IS NOT NULL OR capx IS NOT NULL THEN {_ratio('coalesce(xrd, 0) + coalesce(capx, 0)', 'at_l1')} END, 6) AS total_inv_intensity_y FROM two""")
def derived_measures(spark, d):
    rows = P.derived_measures(unique_panel(spark, d).withColumnRenamed("total_assets", "at"), "firm", "fyear")
    names = ["log_at", "leverage", "cash_ratio", "roa", "markup", "labor_productivity", "operating_profit", "tobins_q", "roa_l1", "asset_growth_y", "rd_intensity_y", "total_inv_intensity_y"]
    return rounded(rows.select("firm", "fyear", "firm_age", "rd_reporter", *names))


@add(f"WITH {SQL_PANEL} SELECT firm, CAST(min(fyear) AS INT) AS first_year FROM panel WHERE firm IS NOT NULL GROUP BY firm")
def first_observed_year(spark, d):
    return P.first_observed(panel(spark, d), "firm", "fyear")


@add("""WITH dim AS (SELECT naics2, max(naics3) AS top_naics3 FROM analysis_panel WHERE naics2 IS NOT NULL GROUP BY naics2)
    SELECT panel_id, top_naics3, CASE WHEN trim(p.naics2) IN ('31', '32', '33') THEN '31-33' WHEN trim(p.naics2) IN ('44', '45') THEN '44-45' WHEN trim(p.naics2) IN ('48', '49') THEN '48-49' ELSE trim(p.naics2) END AS sector,
        CASE WHEN length(CAST(naics AS VARCHAR)) >= 4 THEN substr(CAST(naics AS VARCHAR), 1, 4) END AS naics4 FROM analysis_panel p LEFT JOIN dim USING (naics2)""")
def panel_left_lookups(spark, d):
    rows = table(spark, d, "analysis_panel")
    dim = rows.filter("naics2 is not null").groupBy("naics2").agg(F.max("naics3").alias("top_naics3"))
    return C.lookup_join(rows, dim, ["naics2"]).select("panel_id", "top_naics3", X.sector_code(F.col("naics2")).alias("sector"), X.code_prefix(F.col("naics"), 4).alias("naics4"))


_CANONICAL = f"""{SQL_FILINGS}, canonical AS (SELECT firm, period, accession_number, form_type, filed FROM (
    SELECT *, row_number() OVER (PARTITION BY firm, period ORDER BY CASE form_type WHEN '10-K' THEN 0 ELSE 1 END, filed NULLS LAST, accession_number) AS r
    FROM filings WHERE form_type IN ('10-K', '10-K/A') AND firm IS NOT NULL AND period IS NOT NULL) WHERE r = 1)"""


@add(f"WITH {_CANONICAL} SELECT * FROM canonical")
def canonical_filing(spark, d):
    return R.canonical_filing(filings(spark, d), "firm", "period", "filed", "form_type", "accession_number").select("firm", "period", "accession_number", "form_type", "filed")


@add(f"""WITH {SQL_FILINGS} SELECT firm, accession_number, extract_updated_at, source_url FROM (SELECT *, row_number() OVER (PARTITION BY firm, accession_number ORDER BY nullif(extract_updated_at, '') DESC NULLS FIRST, source_url DESC) AS r
    FROM filings) WHERE r = 1""")
def newest_manifest_row(spark, d):
    rows = filings(spark, d).withColumn("__u", F.nullif(F.col("extract_updated_at"), F.lit("")))
    return R.newest_row(rows, ["firm", "accession_number"], "__u", "source_url").select("firm", "accession_number", "extract_updated_at", "source_url")


def _scores(spark, d):
    """Best usable score of each filing and its date."""
    from panelwright.functions.keys import accession_key

    scored = table(spark, d, "scored_filings").select(firm_key(F.col("cik")).alias("firm"), accession_key(F.col("accession_number")).alias("accession_number"), F.when(F.col("ai_score").between(1, 3), F.col("ai_score")).alias("score"))
    best = scored.filter("firm is not null and accession_number is not null").groupBy("firm", "accession_number").agg(F.max("score").alias("score"))
    dates = filings(spark, d).filter("firm is not null").groupBy("firm", "accession_number").agg(F.min("filed").alias("filed"))
    return best.join(dates, ["firm", "accession_number"])


_DIG = "regexp_replace(regexp_replace(accession_number, '^.*/', ''), '[^0-9]', '', 'g')"
_ACC = f"CASE WHEN length({_DIG}) BETWEEN 1 AND 18 THEN substr(lpad({_DIG}, 18, '0'), 1, 10) || '-' || substr(lpad({_DIG}, 18, '0'), 11, 2) || '-' || substr(lpad({_DIG}, 18, '0'), 13, 6) END"
_SCORES = f"""{SQL_FILINGS}, best AS (SELECT {sql_key('cik')} AS firm, {_ACC} AS acc, max(CASE WHEN ai_score BETWEEN 1 AND 3 THEN ai_score END) AS score FROM scored_filings GROUP BY 1, 2),
    scores AS (SELECT b.firm, b.acc, b.score, f.filed FROM best b JOIN (SELECT firm, accession_number AS acc, min(filed) AS filed FROM filings GROUP BY 1, 2) f ON b.firm = f.firm AND b.acc = f.acc),
    dates AS (SELECT firm, min(CASE WHEN score >= 2 THEN filed END) AS first_date, min(CASE WHEN score = 3 THEN filed END) AS first_strong_date, count(score) AS n_scored FROM scores GROUP BY firm)"""


@add(f"WITH {_SCORES} SELECT * FROM dates")
def treatment_dates(spark, d):
    return R.treatment_dates(_scores(spark, d), "firm", "filed", "score")


_ADOPTION = f"""{SQL_UNIQUE}, {_SCORES}, j AS (SELECT u.firm, fyear, u.year, datadate, first_date, coalesce(n_scored > 0, FALSE) AS has_history, coalesce(datadate > first_date, FALSE) AS aft FROM uniq u LEFT JOIN dates t ON u.firm = t.firm),
    treated AS (SELECT firm, fyear, year, datadate, has_history, CASE WHEN has_history THEN CAST(aft AS INT) END AS adopted,
        CASE WHEN has_history THEN CAST(coalesce(min(CASE WHEN aft THEN year END) OVER (PARTITION BY firm), 0) AS INT) END AS adoption_year FROM j)"""


def _treated(spark, d):
    dates = R.treatment_dates(_scores(spark, d), "firm", "filed", "score")
    return R.absorbing_treatment(unique_panel(spark, d), dates, "firm", "datadate", "year")


@add(f"WITH {_ADOPTION} SELECT firm, fyear, has_history, adopted, adoption_year FROM treated")
def absorbing_treatment(spark, d):
    return _treated(spark, d).select("firm", "fyear", "has_history", "adopted", "adoption_year")


@add(f"WITH {_ADOPTION} SELECT year, count(adopted) AS n, CAST(sum(adopted) AS BIGINT) AS n_treated, round(avg(adopted), 6) AS share FROM treated GROUP BY year")
def firm_year_treatment_panel(spark, d):
    """Flagship: annual panel, canonical scores, treatment dates, absorbing treatment and its prevalence by year."""
    return rounded(R.prevalence(_treated(spark, d), "year", "adopted"))


@add(f"WITH {_ADOPTION} SELECT adoption_year, count(DISTINCT firm) AS n_firms, count(*) AS n_rows FROM treated WHERE adoption_year IS NOT NULL GROUP BY adoption_year")
def adoption_cohorts(spark, d):
    return _treated(spark, d).filter("adoption_year is not null").groupBy("adoption_year").agg(F.count_distinct("firm").alias("n_firms"), F.count(F.lit(1)).alias("n_rows"))


@add(f"""WITH {SQL_UNIQUE}, f AS (SELECT firm, min(CASE WHEN ai_adopted = 1 THEN year END) AS first_treated, max(ai_adoption_year) AS cohort FROM uniq GROUP BY firm)
    SELECT firm, CAST(first_treated AS INT) AS first_treated, CAST(cohort AS INT) AS cohort FROM f WHERE cohort IS NOT NULL AND coalesce(first_treated, 0) <> cohort""")
def cohort_mismatch(spark, d):
    return R.cohort_mismatch(unique_panel(spark, d), "firm", "year", "ai_adopted", "ai_adoption_year")


_RULES = {
    "adopted without history": "ai_adopted IS NOT NULL AND NOT has_ai_history",
    "adopted in or before the first filing": "ai_adopted = 1 AND datadate <= first_ai_filing_date",
    "not adopted after the first filing": "ai_adopted = 0 AND datadate > first_ai_filing_date",
    "strong date before the first": "first_ai3_filing_date < first_ai_filing_date",
    "strong date without a first": "first_ai3_filing_date IS NOT NULL AND first_ai_filing_date IS NULL",
    "adoption year after the period although adopted": "ai_adopted = 1 AND ai_adoption_year > year",
    "adopted without an adoption year": "ai_adopted = 1 AND coalesce(ai_adoption_year, 0) = 0",
    "score out of range": "ai_score NOT BETWEEN 1 AND 3",
}


@add(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS rows FROM analysis_panel" for k, v in _RULES.items()))
def treatment_invariants(spark, d):
    return C.violations(table(spark, d, "analysis_panel"), {k: F.expr(v) for k, v in _RULES.items()})


@add(f"""WITH {SQL_UNIQUE}, l AS (SELECT *, lag(fyear) OVER w AS p, CASE WHEN fyear = lag(fyear) OVER w + 1 THEN lag(total_assets) OVER w END AS a FROM uniq WINDOW w AS (PARTITION BY firm ORDER BY fyear))
    SELECT 'lag across a gap' AS rule, count(*) FILTER (WHERE a IS NOT NULL AND fyear <> p + 1) AS rows FROM l UNION ALL SELECT 'lag lost', count(*) FILTER (WHERE fyear = p + 1 AND a IS NULL) FROM l""")
def lag_integrity(spark, d):
    rows = P.consecutive_lags(unique_panel(spark, d), "firm", "fyear", ["total_assets"])
    return C.violations(rows, {"lag across a gap": F.col("total_assets_l1").isNotNull() & (F.col("fyear") != F.col("lag_source_fyear") + 1), "lag lost": (F.col("fyear") == F.col("lag_source_fyear") + 1) & F.col("total_assets_l1").isNull()})


@add("WITH y AS (SELECT year, count(*) FILTER (WHERE ai_score IS NOT NULL) AS n FROM analysis_panel WHERE year IS NOT NULL GROUP BY year), l AS (SELECT year, n, lag(n) OVER (ORDER BY year) AS before FROM y) SELECT year, n, before, coalesce(n < 0.5 * before, FALSE) AS dropped FROM l")
def coverage_drop_flags(spark, d):
    return C.coverage_drops(table(spark, d, "analysis_panel"), "year", F.col("ai_score").isNotNull())


@add(f"WITH {SQL_PANEL} SELECT firm, fyear, count(*) AS rows FROM panel GROUP BY firm, fyear HAVING count(*) > 1")
def duplicate_firm_years(spark, d):
    return C.duplicate_keys(panel(spark, d), ["firm", "fyear"])


@add(f"WITH {SQL_PANEL}, c AS (SELECT firm, count(DISTINCT naics2) AS a, count(DISTINCT emp) AS b, count(DISTINCT indfmt) AS e FROM panel WHERE firm IS NOT NULL GROUP BY firm) SELECT firm, 'naics2' AS \"column\", a AS \"values\" FROM c WHERE a > 1 UNION ALL SELECT firm, 'emp', b FROM c WHERE b > 1 UNION ALL SELECT firm, 'indfmt', e FROM c WHERE e > 1")
def varying_covariates(spark, d):
    return C.varying_within(panel(spark, d), "firm", ["naics2", "emp", "indfmt"])


@add(f"""WITH {SQL_PANEL}, a AS (SELECT DISTINCT firm FROM panel), b AS (SELECT DISTINCT {sql_key('cik')} AS firm FROM scored_filings)
    SELECT firm, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT firm, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def firm_key_difference(spark, d):
    return C.key_difference(panel(spark, d), table(spark, d, "scored_filings").select(firm_key(F.col("cik")).alias("firm")), ["firm"])


@add(f"WITH {SQL_PANEL} SELECT panel_id FROM panel WHERE firm IN (SELECT {sql_key('cik')} FROM treatment_history WHERE {sql_key('cik')} IS NOT NULL)")
def firms_with_history_semi(spark, d):
    known = table(spark, d, "treatment_history").select(firm_key(F.col("cik")).alias("firm"))
    return panel(spark, d).join(known, "firm", "left_semi").select("panel_id")


@add(f"WITH {SQL_PANEL} SELECT panel_id FROM panel p WHERE NOT EXISTS (SELECT 1 FROM treatment_history h WHERE {sql_key('h.cik')} = p.firm)")
def firms_without_history_anti(spark, d):
    known = table(spark, d, "treatment_history").select(firm_key(F.col("cik")).alias("firm"))
    return panel(spark, d).join(known, "firm", "left_anti").select("panel_id")


# Paths: levels 0 to 2, a firm's highest usable score of a year less 1.
_LEVELS = f"{SQL_UNIQUE}, lv AS (SELECT {sql_key('cik')} AS firm, year AS fyear, CAST(max(ai_score) - 1 AS INT) AS level FROM scored_filings WHERE ai_score BETWEEN 1 AND 3 AND year BETWEEN 1993 AND 2027 AND {sql_key('cik')} IS NOT NULL GROUP BY 1, 2)"


def _levels(spark, d):
    rows = table(spark, d, "scored_filings").filter(X.is_in(F.col("ai_score"), [1, 2, 3]) & F.col("year").between(1993, 2027))
    rows = rows.select(firm_key(F.col("cik")).alias("firm"), F.col("year").alias("fyear"), "ai_score").filter("firm is not null")
    return rows.groupBy("firm", "fyear").agg((F.max("ai_score") - 1).alias("level"))


_SWITCH = f"""{_LEVELS}, ini AS (SELECT *, first_value(level) OVER (PARTITION BY firm ORDER BY fyear) AS f FROM lv),
    sw AS (SELECT firm, min(f) AS initial, min(CASE WHEN level <> f THEN fyear END) AS first_switch_year FROM ini GROUP BY firm)"""


@add(f"WITH {_SWITCH} SELECT s.firm, CAST(initial AS INT) AS initial, CAST(first_switch_year AS INT) AS first_switch_year, CAST(sign(l.level - initial) AS INT) AS direction FROM sw s LEFT JOIN lv l ON l.firm = s.firm AND l.fyear = s.first_switch_year")
def initial_and_first_switch(spark, d):
    return H.first_switch(_levels(spark, d), "firm", "fyear", "level")


_STEPS = f"{_LEVELS}, st AS (SELECT *, lag(level) OVER (PARTITION BY firm ORDER BY fyear) AS before FROM lv)"


@add(f"WITH {_STEPS}, c AS (SELECT *, CAST(coalesce(level <> before, FALSE) AS INT) AS ch FROM st) SELECT firm, fyear, before, \"after\", change_no FROM (SELECT firm, fyear, before, level AS \"after\", ch, CAST(sum(ch) OVER (PARTITION BY firm ORDER BY fyear) AS INT) AS change_no FROM c) WHERE ch = 1")
def transition_events(spark, d):
    return H.transitions(_levels(spark, d), "firm", "fyear", "level")


@add(f"WITH {_STEPS}, t AS (SELECT before, level AS \"after\", count(*) AS n FROM st WHERE level <> before GROUP BY ALL) SELECT before, \"after\", n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM t")
def transition_counts(spark, d):
    from panelwright.operators.describe import shares

    return rounded(shares(H.transitions(_levels(spark, d), "firm", "fyear", "level"), ["before", "after"], ["before"]))


@add(f"WITH {_LEVELS}, s AS (SELECT firm, level < lag(level) OVER (PARTITION BY firm ORDER BY fyear) AS down FROM lv) SELECT firm, count(*) FILTER (WHERE down) AS n_falls, coalesce(bool_or(down), FALSE) AS reversed FROM s GROUP BY firm")
def reversal_check(spark, d):
    return R.reversals(_levels(spark, d), "firm", "fyear", "level")


@add(f"""WITH {_STEPS}, z AS (SELECT firm, min(CASE WHEN level = 0 THEN fyear END) AS y0 FROM lv GROUP BY firm), o AS (SELECT l.firm, min(l.fyear) AS y1 FROM lv l JOIN z USING (firm) WHERE level = 1 AND l.fyear > y0 GROUP BY l.firm),
    t AS (SELECT l.firm, TRUE AS ok FROM lv l JOIN o USING (firm) WHERE level = 2 AND l.fyear > y1 GROUP BY l.firm)
    SELECT s.firm, string_agg(CAST(level AS VARCHAR), '->' ORDER BY fyear) AS path, count(*) AS n_years, count(*) FILTER (WHERE level > before) AS n_up, count(*) FILTER (WHERE level < before) AS n_down,
        coalesce(bool_or(t.ok), FALSE) AS ordered_0_1_2, coalesce(bool_or(before = 0 AND level = 2), FALSE) AS direct_0_2 FROM st s LEFT JOIN t USING (firm) GROUP BY s.firm""")
def intensity_paths(spark, d):
    return H.path_summary(_levels(spark, d), "firm", "fyear", "level")


@add(f"""WITH {_SWITCH}, y AS (SELECT u.firm, u.fyear, s.first_switch_year AS sy FROM lv u JOIN sw s USING (firm)), b AS (SELECT firm, fyear, sy, row_number() OVER (PARTITION BY firm ORDER BY fyear DESC) AS k FROM y WHERE fyear < sy),
    n AS (SELECT firm, count(*) AS n_pre FROM b WHERE fyear = sy - k GROUP BY firm) SELECT f.firm, coalesce(n_pre, 0) AS n_pre FROM (SELECT DISTINCT firm FROM y WHERE sy IS NOT NULL) f LEFT JOIN n USING (firm)""")
def pre_period_runs(spark, d):
    levels = _levels(spark, d)
    return H.run_before(levels.join(H.first_switch(levels, "firm", "fyear", "level"), "firm"), "firm", "fyear", "first_switch_year")


@add(f"""WITH {_SWITCH}, y AS (SELECT u.*, s.first_switch_year AS sy FROM uniq u JOIN sw s USING (firm))
    SELECT firm, fyear AS base_year, sale AS sale_pre, ni AS ni_pre FROM y WHERE fyear = sy - 1 UNION ALL
    SELECT firm, fyear, sale, ni FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY fyear) AS q FROM y WHERE sy IS NULL AND sale IS NOT NULL AND ni IS NOT NULL) WHERE q = 1""")
def pre_switch_baselines(spark, d):
    switch = H.first_switch(_levels(spark, d), "firm", "fyear", "level").select("firm", "first_switch_year")
    return H.baselines(unique_panel(spark, d).join(switch, "firm"), "firm", "fyear", "first_switch_year", ["sale", "ni"])


@add(f"""WITH {SQL_UNIQUE}, k AS (SELECT DISTINCT firm FROM uniq), ix AS (SELECT firm, CAST(row_number() OVER (ORDER BY firm) AS INT) AS firm_id FROM k) SELECT firm, fyear, firm_id FROM uniq JOIN ix USING (firm)""")
def dense_firm_ids(spark, d):
    rows = unique_panel(spark, d).select("firm", "fyear")
    return rows.join(dense_index(rows, "firm", "firm_id").withColumn("firm_id", F.col("firm_id").cast("int")), "firm")


@add(f"""WITH {SQL_UNIQUE}, r AS (SELECT * FROM uniq WHERE has_ai_history AND ai_adoption_year IS NOT NULL AND (ai_adoption_year = 0 OR (ai_adoption_year >= 2016 AND year <= ai_adoption_year)))
    SELECT firm, fyear, CAST(year = ai_adoption_year AS INT) AS event FROM r""")
def risk_set(spark, d):
    from panelwright.estimators.lpm import risk_set as build

    return build(unique_panel(spark, d).filter("has_ai_history"), "year", "ai_adoption_year", 2016).select("firm", "fyear", "event")


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
