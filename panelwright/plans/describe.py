"""Queries of descriptive statistics, surveys and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.functions.keys import firm_key
from panelwright.operators import describe as D
from panelwright.plans.common import SQL_FILINGS, SQL_PANEL, SQL_UNIQUE, Registry, filings, panel, rounded, sql_key, table, unique_panel

registry = Registry()
add = registry.add
VARIABLES = ["total_assets", "sale", "emp", "ni"]


def _long(src: str, keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM {src}" for v in VARIABLES)


_STATS = """count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
    round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max"""


@add(f"WITH l AS ({_long('analysis_panel')}) SELECT variable, {_STATS} FROM l GROUP BY variable")
def descriptive_table(spark, d):
    return rounded(D.summary_table(table(spark, d, "analysis_panel"), VARIABLES), 4)


@add(f"WITH l AS ({_long('analysis_panel', 'ai_adopted, ')}) SELECT ai_adopted, variable, {_STATS} FROM l GROUP BY ai_adopted, variable")
def group_summary(spark, d):
    return rounded(D.summary_table(table(spark, d, "analysis_panel"), VARIABLES, ["ai_adopted"]), 4)


@add("SELECT count(sale) AS n, round(avg(sale), 4) AS mean, round(stddev_samp(sale), 4) AS sd, " + ", ".join(f"round(quantile_cont(sale, {p / 100}), 4) AS p{p:02d}" for p in (1, 5, 50, 95, 99)) + " FROM analysis_panel")
def quick_stats(spark, d):
    return rounded(D.quick_stats(table(spark, d, "analysis_panel"), "sale"), 4)


@add(f"SELECT panel_id, variable, value FROM (SELECT panel_id, t.* FROM analysis_panel, LATERAL (SELECT unnest({VARIABLES}) AS variable, unnest([total_assets, sale, emp, ni]) AS value) t)")
def wide_to_long(spark, d):
    return D.to_long(table(spark, d, "analysis_panel"), ["panel_id"], VARIABLES)


@add("SELECT panel_id, total_assets, sale, emp, ni FROM analysis_panel")
def long_to_wide_round_trip(spark, d):
    return D.to_wide(D.to_long(table(spark, d, "analysis_panel"), ["panel_id"], VARIABLES), ["panel_id"], "variable", "value", VARIABLES)


@add("SELECT CASE WHEN count(*) >= 5 THEN count(*) END AS n, round(covar_samp(ln_a, ln_s) / nullif(stddev_samp(ln_a) * stddev_samp(ln_s), 0), 6) AS correlation FROM (SELECT CASE WHEN total_assets > 0 THEN ln(total_assets) END AS ln_a, CASE WHEN sale > 0 THEN ln(sale) END AS ln_s FROM analysis_panel) WHERE ln_a IS NOT NULL AND ln_s IS NOT NULL")
def log_correlation(spark, d):
    rows = table(spark, d, "analysis_panel").select(X.safe_log(F.col("total_assets")).alias("a"), X.safe_log(F.col("sale")).alias("s"))
    return rounded(D.correlation(rows, "a", "s"))


@add("SELECT naics2, count(*) AS n, round(sum(ai_score * emp) / nullif(sum(emp), 0), 6) AS mean FROM analysis_panel WHERE ai_score IS NOT NULL AND emp IS NOT NULL GROUP BY naics2")
def sector_weighted_mean(spark, d):
    return rounded(D.weighted_mean(table(spark, d, "analysis_panel"), ["naics2"], "ai_score", "emp"))


@add("SELECT ai_score, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored_filings GROUP BY ai_score")
def score_distribution(spark, d):
    return rounded(D.shares(table(spark, d, "scored_filings"), ["ai_score"]))


@add("SELECT year, ai_score, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM scored_filings GROUP BY year, ai_score")
def score_mix_by_year(spark, d):
    return rounded(D.shares(table(spark, d, "scored_filings"), ["year", "ai_score"], ["year"]))


@add("SELECT naics2, count(*) AS n, count(ai_adopted) AS n_known, CAST(sum(ai_adopted) AS BIGINT) AS n_adopted, round(avg(ai_adopted), 6) AS share, count(DISTINCT gvkey) AS n_firms FROM analysis_panel WHERE naics2 IS NOT NULL GROUP BY naics2")
def industry_adoption(spark, d):
    rows = table(spark, d, "analysis_panel").filter("naics2 is not null")
    return rounded(rows.groupBy("naics2").agg(F.count(F.lit(1)).alias("n"), F.count("ai_adopted").alias("n_known"), F.sum("ai_adopted").cast("long").alias("n_adopted"), F.avg("ai_adopted").alias("share"), F.count_distinct("gvkey").alias("n_firms")))


_ARMS = f"WITH {SQL_UNIQUE}, l AS ({_long('uniq', 'ai_adopted, ')})"
_T, _C = "CASE WHEN ai_adopted = 1 THEN value END", "CASE WHEN ai_adopted = 0 THEN value END"


@add(f"""{_ARMS} SELECT variable, count({_T}) AS n_treated, round(avg({_T}), 4) AS mean_treated, round(stddev_samp({_T}), 4) AS sd_treated, count({_C}) AS n_control, round(avg({_C}), 4) AS mean_control, round(stddev_samp({_C}), 4) AS sd_control,
    round(avg({_T}) - avg({_C}), 4) AS difference, round(sqrt(var_samp({_T}) / count({_T}) + var_samp({_C}) / count({_C})), 4) AS se FROM l WHERE ai_adopted IS NOT NULL GROUP BY variable""")
def balance_table(spark, d):
    return rounded(D.balance(unique_panel(spark, d), "ai_adopted", VARIABLES).drop("p_value"), 4)


@add()
def balance_p_values(spark, d):
    """Normal p-values have no SQL; tests derive them from erfc."""
    return D.balance(unique_panel(spark, d), "ai_adopted", VARIABLES).select("variable", "p_value")


@add(f"""{_ARMS} SELECT variable, round((avg({_T}) - avg({_C})) / nullif(sqrt((var_samp({_T}) + var_samp({_C})) / 2), 0), 6) AS smd, round(quantile_cont({_T}, 0.5), 6) AS median_treated, round(quantile_cont({_C}, 0.5), 6) AS median_control
    FROM l WHERE ai_adopted IS NOT NULL GROUP BY variable""")
def standardized_mean_diff(spark, d):
    return rounded(D.standardized_difference(unique_panel(spark, d), "ai_adopted", VARIABLES))


@add(f"WITH {SQL_UNIQUE} SELECT firm, count(*) AS n, round(avg(sale), 8) AS sale, round(avg(ni), 8) AS ni FROM uniq WHERE ai_adoption_year = 0 OR year < ai_adoption_year GROUP BY firm")
def pre_treatment_means(spark, d):
    rows = unique_panel(spark, d).filter("ai_adoption_year = 0 or year < ai_adoption_year")
    return rounded(rows.groupBy("firm").agg(F.count(F.lit(1)).alias("n"), F.avg("sale").alias("sale"), F.avg("ni").alias("ni")), 8)


@add(f"""SELECT firm, year, CAST(max(s) AS INT) AS max_score, string_agg(DISTINCT accession_number, ';' ORDER BY accession_number) AS accessions, count(*) AS n_filings, count(s) AS n_scored, count(*) FILTER (WHERE s IS NULL) AS n_failed,
    CASE WHEN bool_or(parse_status = 'retry_success') THEN 'retry_success' WHEN bool_or(parse_status IN ('ok', 'success', 'not_called')) THEN 'success' ELSE 'failed' END AS status
    FROM (SELECT {sql_key('cik')} AS firm, year, accession_number, parse_status, CASE WHEN ai_score BETWEEN 1 AND 3 THEN ai_score END AS s FROM scored_filings) WHERE firm IS NOT NULL AND year IS NOT NULL GROUP BY firm, year""")
def firm_year_max_score(spark, d):
    rows = table(spark, d, "scored_filings").select(firm_key(F.col("cik")).alias("firm"), "year", "accession_number", "parse_status", F.when(F.col("ai_score").between(1, 3), F.col("ai_score")).alias("s"))
    return D.firm_year_maximum(rows, "firm", "year", "s", "parse_status", "accession_number")


@add(f"WITH {SQL_FILINGS}, k AS (SELECT firm, company_name, row_number() OVER (PARTITION BY firm ORDER BY filing_date, accession_number, company_name) AS r FROM filings WHERE trim(company_name) <> '') SELECT firm, company_name FROM k WHERE r = 1")
def first_company_name(spark, d):
    return D.first_known(filings(spark, d), ["firm"], "company_name", ["filing_date", "accession_number"])


_WAVES = "w AS (SELECT event_type AS code, CAST(year(ts) * 100 + month(ts) AS INT) AS wave, count(*) FILTER (WHERE value > 50) / count(*) AS share, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY ALL)"


def _waves(spark, d):
    wave = (F.year("ts") * 100 + F.month("ts")).cast("int")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("code"), wave.alias("wave")).agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("share"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))


@add(f"WITH {_WAVES} SELECT code, CAST(arg_max(wave, wave) AS INT) AS latest_period, round(arg_max(share, wave), 6) AS latest_value, round(avg(share), 6) AS mean_all, round(avg(CASE WHEN wave BETWEEN 202301 AND 202412 THEN share END), 6) AS mean_2324 FROM w WHERE share IS NOT NULL GROUP BY code")
def survey_summary_latest(spark, d):
    return rounded(D.latest_known(_waves(spark, d), ["code"], "share", "wave", {"mean_all": (0, 999999), "mean_2324": (202301, 202412)}))


@add(f"""WITH {_WAVES}, e AS (SELECT code, wave, share FROM w WHERE share > 0.4), s AS (SELECT code, wave, se FROM w WHERE se < 100), dt AS (SELECT DISTINCT wave, CAST(wave // 100 AS INT) AS reference_year FROM w), ti AS (SELECT DISTINCT code, upper(code) AS title FROM w WHERE code <> 'click')
    SELECT code, wave, round(share, 6) AS share, round(se, 6) AS se, reference_year, title FROM e FULL JOIN s USING (code, wave) LEFT JOIN dt USING (wave) LEFT JOIN ti USING (code)""")
def survey_long(spark, d):
    w = _waves(spark, d)
    dates = w.select("wave", F.floor(F.col("wave") / 100).cast("int").alias("reference_year")).distinct()
    titles = w.filter("code <> 'click'").select("code", F.upper("code").alias("title")).distinct()
    return rounded(D.survey_long(w.filter("share > 0.4").select("code", "wave", "share"), w.filter("se < 100").select("code", "wave", "se"), ["code", "wave"], dates, "wave", titles, "code"))


@add(f"""WITH a AS (SELECT year, count(*) AS n_panel FROM analysis_panel WHERE year IS NOT NULL GROUP BY year), b AS (SELECT year, count(*) AS n_filings FROM filing_manifest WHERE year IS NOT NULL GROUP BY year), c AS (SELECT year, count(*) AS n_other FROM scored_filings WHERE year IS NOT NULL GROUP BY year)
    SELECT year, coalesce(n_panel, 0) AS n_panel, coalesce(n_filings, 0) AS n_filings, coalesce(n_other, 0) AS n_other FROM a FULL JOIN b USING (year) LEFT JOIN c USING (year)""")
def panel_by_year_full_join(spark, d):
    return D.yearly_overview(table(spark, d, "analysis_panel"), table(spark, d, "filing_manifest"), table(spark, d, "scored_filings"), "year")


@add("""WITH a AS (SELECT naics2, avg(CASE WHEN ai_score >= 2 THEN 1.0 ELSE 0.0 END) AS x FROM analysis_panel WHERE ai_score IS NOT NULL AND naics2 IS NOT NULL GROUP BY naics2), b AS (SELECT naics2, avg(CAST(ai_adopted AS DOUBLE)) AS y FROM analysis_panel WHERE naics2 IS NOT NULL AND ai_adopted IS NOT NULL GROUP BY naics2), j AS (SELECT x, y FROM a JOIN b USING (naics2))
    SELECT count(*) AS n, CASE WHEN count(*) >= 5 THEN round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) END AS correlation FROM j""")
def external_validation_corr(spark, d):
    rows = table(spark, d, "analysis_panel").filter("naics2 is not null")
    a = rows.filter("ai_score is not null").groupBy("naics2").agg(F.avg(F.when(F.col("ai_score") >= 2, 1.0).otherwise(0.0)).alias("x"))
    b = rows.filter("ai_adopted is not null").groupBy("naics2").agg(F.avg("ai_adopted").alias("y"))
    return rounded(D.correlation(a.join(b, "naics2"), "x", "y"))


@add("SELECT naics2, count(*) AS n, round(covar_samp(sale, ni) / nullif(var_samp(sale), 0), 6) AS slope, round(avg(ni) - covar_samp(sale, ni) / nullif(var_samp(sale), 0) * avg(sale), 3) AS intercept FROM analysis_panel WHERE sale IS NOT NULL AND ni IS NOT NULL GROUP BY naics2")
def income_slope(spark, d):
    return D.slope(table(spark, d, "analysis_panel"), ["naics2"], "ni", "sale").select("naics2", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@add(f"WITH {SQL_PANEL} SELECT count(*) AS n_rows, count(DISTINCT firm) AS n_firms, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year, count(*) FILTER (WHERE has_ai_history) AS n_history, count(*) FILTER (WHERE ai_score IS NOT NULL) AS n_scored, round(avg(CASE WHEN ai_adopted = 1 THEN 1.0 WHEN ai_adopted = 0 THEN 0.0 END), 6) AS share_adopted FROM panel")
def panel_overview(spark, d):
    return rounded(panel(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("firm").alias("n_firms"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if("has_ai_history").alias("n_history"), F.count_if(F.col("ai_score").isNotNull()).alias("n_scored"), F.avg(F.when(F.col("ai_adopted").isin(0, 1), F.col("ai_adopted"))).alias("share_adopted")))


@add("SELECT panel_id, round_even(sale, 1) AS sale FROM analysis_panel WHERE sale IS NOT NULL")
def rounded_for_display(spark, d):
    return D.round_numbers(table(spark, d, "analysis_panel").select("panel_id", "sale").filter("sale is not null"), 1)


@add("SELECT 'panel' AS source, cik, year, gvkey, CAST(NULL AS VARCHAR) AS form_type FROM analysis_panel UNION ALL SELECT 'filing', cik, year, NULL, form_type FROM filing_manifest")
def union_with_fill(spark, d):
    return D.union_all([table(spark, d, "analysis_panel").select("cik", "year", "gvkey"), table(spark, d, "filing_manifest").select("cik", "year", "form_type")], ["panel", "filing"])


@add("SELECT parse_status, count(*) AS n FROM responses GROUP BY parse_status")
def status_counts(spark, d):
    return table(spark, d, "responses").groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT panel_id, CASE WHEN sale > 0 THEN round(ln(sale), 6) END AS log_sale, CASE WHEN total_assets > 0 THEN round(ni / total_assets, 6) END AS roa, round(CASE WHEN dltt IS NULL AND che IS NULL THEN NULL ELSE coalesce(dltt, 0) + coalesce(che, 0) END, 6) AS both_sum,
    CAST((dltt IS NULL)::INT + (che IS NULL)::INT + (emp IS NULL)::INT AS INT) AS n_null, (dltt IS NOT NULL AND che IS NOT NULL) AS all_known, (dltt IS NOT NULL OR che IS NOT NULL) AS any_known, coalesce(exchg IN (11, 14), FALSE) AS listed,
    CASE WHEN fyear >= first_compustat_fyear THEN CAST(fyear - first_compustat_fyear AS INT) END AS age FROM analysis_panel""")
def guarded_measures(spark, d):
    c = F.col
    rows = table(spark, d, "analysis_panel").select(
        "panel_id", X.safe_log(c("sale")).alias("log_sale"), X.ratio(c("ni"), c("total_assets")).alias("roa"), X.null_sum(c("dltt"), c("che")).alias("both_sum"), X.null_count(["dltt", "che", "emp"]).alias("n_null"),
        X.all_known(["dltt", "che"]).alias("all_known"), X.any_known(["dltt", "che"]).alias("any_known"), X.is_in(c("exchg"), [11, 14]).alias("listed"), F.when(c("fyear") >= c("first_compustat_fyear"), c("fyear") - c("first_compustat_fyear")).alias("age"),
    )
    return rounded(rows)


@add(f"""SELECT panel_id, {sql_key('cik')} AS firm, CASE WHEN TRY_CAST(cik AS DOUBLE) IS NOT NULL THEN CAST(CAST(trunc(TRY_CAST(cik AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS numeric_firm, CAST(nullif(regexp_extract(CAST(datadate AS VARCHAR), '^\\s*([0-9]{{4}})', 1), '') AS INT) AS y,
    CASE WHEN ni < -1000 THEN '***' WHEN ni < -100 THEN '**' WHEN ni < 0 THEN '*' ELSE '' END AS marks FROM analysis_panel""")
def key_forms(spark, d):
    c = F.col
    return table(spark, d, "analysis_panel").select("panel_id", firm_key(c("cik")).alias("firm"), X.numeric_key(c("cik")).alias("numeric_firm"), X.parse_year(c("datadate").cast("string")).alias("y"), X.stars(c("ni"), ((-1000, "***"), (-100, "**"), (0, "*"))).alias("marks"))


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
