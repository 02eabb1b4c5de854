"""Queries of recodes, grids, scoring runs, gates and document formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.estimators import did as D
from panelwright.estimators import lpm as L
from panelwright.functions import exprs as X
from panelwright.operators import grid as G
from panelwright.operators import manifest as M
from panelwright.operators import recode as R
from panelwright.operators import runs as U
from panelwright.operators import scoring as S
from panelwright.operators import text as W
from panelwright.plans import estimates as E
from panelwright.plans.common import SQL_PANEL, SQL_UNIQUE, Registry, panel, rounded, table, unique_panel
from panelwright.plans.text import _WIN, PLAIN

registry = Registry()
add = registry.add

# Recodes


@add("SELECT panel_id, year, 2018 AS cap FROM analysis_panel WHERE year <= 2018 UNION ALL SELECT panel_id, year, 0 FROM analysis_panel")
def capped_years(spark, d):
    rows = table(spark, d, "analysis_panel").select("panel_id", "year")
    return R.year_cap(rows, "year", 2018).withColumn("cap", F.lit(2018)).unionByName(R.year_cap(rows, "year", 0).withColumn("cap", F.lit(0)))


@add("SELECT accession_number, download_status AS raw_status, download_bytes AS raw_bytes, extract_status AS windows_status FROM filing_manifest")
def renamed_prefixes(spark, d):
    rows = table(spark, d, "filing_manifest").select("accession_number", "download_status", "download_bytes", "extract_status")
    return R.rename_prefixes(rows, {"download_": "raw_", "extract_": "windows_"})


@add("SELECT panel_id, CASE WHEN ai_score BETWEEN 1 AND 3 THEN ai_score - 1 END AS intensity FROM analysis_panel")
def intensity_recode(spark, d):
    return table(spark, d, "analysis_panel").select("panel_id", R.intensity(F.col("ai_score")).alias("intensity"))


@add("SELECT panel_id, CASE WHEN coalesce(capx, 0) >= 0 THEN coalesce(capx, 0) END AS spent, CAST(CASE WHEN coalesce(capx, 0) >= 0 THEN coalesce(capx, 0) END > 0 AS INT) AS spent_binary, round(CASE WHEN coalesce(capx, 0) >= 0 AND total_assets > 0 THEN coalesce(capx, 0) / total_assets END, 6) AS spent_intensity FROM analysis_panel")
def spending_recodes(spark, d):
    return rounded(R.spending(table(spark, d, "analysis_panel"), "capx", "total_assets", "spent").select("panel_id", "spent", "spent_binary", "spent_intensity"))


@add("SELECT panel_id, round(sale * ai_score, 2) + 0.0 AS sale_x, round(emp * ai_score, 2) + 0.0 AS emp_x, round(sale * (year - 2015), 2) + 0.0 AS sale_trend FROM analysis_panel")
def interactions_and_trends(spark, d):
    rows = R.interactions(table(spark, d, "analysis_panel"), ["sale", "emp"], "ai_score", "_x")
    return rounded(R.trends(rows, ["sale"], "year", 2015).select("panel_id", "sale_x", "emp_x", "sale_trend"), 2)


@add("SELECT record_id, CAST(row_number() OVER (PARTITION BY accession_number ORDER BY form_type NULLS FIRST, ai_score DESC NULLS LAST, record_id) AS INT) AS rank FROM scored_filings")
def stable_order(spark, d):
    order = [F.col("form_type").asc_nulls_first(), F.col("ai_score").desc_nulls_last()]
    return R.stable_rank(table(spark, d, "scored_filings"), ["accession_number"], order, "record_id").select("record_id", "rank")


@add("SELECT record_id, chunk_id, keyword_hits FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY keyword_hits DESC NULLS LAST, record_id) AS r FROM scored_filings) WHERE r <= 25")
def top_rows_of_chunks(spark, d):
    """The reviewers' list: its length is the feature."""
    return R.head(table(spark, d, "scored_filings"), ["chunk_id"], [F.col("keyword_hits").desc_nulls_last(), F.col("record_id").asc()], 25).select("record_id", "chunk_id", "keyword_hits")


@add("SELECT source, lang, n, CAST(row_number() OVER (ORDER BY n DESC, source NULLS FIRST, lang NULLS FIRST) AS INT) AS place FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)")
def sorted_value_counts(spark, d):
    return R.sorted_counts(table(spark, d, "documents"), ["source", "lang"])


# Grids and tables

_CELLS = {"outcome": ["sale", "capx", "oibdp"], "since": [2012, 2016]}


@add("SELECT outcome, CAST(since AS INT) AS since, CAST(row_number() OVER (ORDER BY o, since) AS INT) AS model, CAST(100 + row_number() OVER (ORDER BY o, since) - 1 AS INT) AS seed FROM (VALUES (1, 'sale'), (2, 'capx'), (3, 'oibdp')) a(o, outcome) CROSS JOIN (VALUES (2012), (2016)) b(since) WHERE NOT (outcome = 'capx' AND since = 2012)")
def model_grid(spark, d):
    return G.grid(spark, _CELLS, "outcome string, since int", drop=lambda c: c == {"outcome": "capx", "since": 2012}, seed=100)


@add(" UNION ALL ".join(f"SELECT '{o}' AS outcome, CAST({y} AS INT) AS since, CAST({i} AS INT) AS model, has_ai_history AS arm, count({o}) AS n, round(avg({o}), 4) AS mean FROM analysis_panel WHERE year >= {y} GROUP BY has_ai_history" for i, (o, y) in enumerate(((o, y) for o in _CELLS["outcome"] for y in _CELLS["since"]), 1)))
def results_over_grid(spark, d):
    rows = table(spark, d, "analysis_panel")

    def run(cell):
        return rows.filter(F.col("year") >= cell["since"]).groupBy(F.col("has_ai_history").alias("arm")).agg(F.count(cell["outcome"]).alias("n"), F.avg(cell["outcome"]).alias("mean"))

    return rounded(G.over_grid(G.grid(spark, _CELLS, "outcome string, since int"), run), 4)


@add("WITH r AS (SELECT DISTINCT run_id FROM scored_filings), s AS (SELECT source_label FROM score_sources) SELECT run_id, source_label FROM r CROSS JOIN s WHERE (run_id, source_label) NOT IN (SELECT run_id, source_label FROM scored_filings WHERE ai_score = 3)")
def missing_outputs(spark, d):
    scored = table(spark, d, "scored_filings")
    runs = sorted(r[0] for r in scored.select("run_id").distinct().collect())  # a run is a plan of its own
    labels = sorted(r[0] for r in table(spark, d, "score_sources").collect())
    expected = G.grid(spark, {"run_id": runs, "source_label": labels}, "run_id string, source_label string").drop("model")
    return G.missing_outputs(expected, scored.filter("ai_score = 3"), ["run_id", "source_label"])


_ARMS = "(SELECT naics2, ai_score, count(sale) AS n, avg(sale) AS m, stddev_samp(sale) / sqrt(count(sale)) AS e FROM analysis_panel WHERE ai_score BETWEEN 1 AND 3 GROUP BY naics2, ai_score)"
_CELL = "CASE WHEN line = 1 THEN printf('%.2f', round(m, 2)) || CASE WHEN e > 0 AND m / e > 2.5758 THEN '***' WHEN e > 0 AND m / e > 1.96 THEN '**' ELSE '' END WHEN e IS NOT NULL THEN '(' || printf('%.2f', round(e, 2)) || ')' END"


@add("SELECT naics2, CAST(line AS INT) AS line, " + ", ".join(f"coalesce(max(CASE WHEN ai_score = {s} THEN c END), '') AS \"{s}\"" for s in (1, 2, 3)) + f" FROM (SELECT naics2, ai_score, line, {_CELL} AS c FROM {_ARMS} CROSS JOIN (VALUES (1), (2)) l(line) WHERE m IS NOT NULL) GROUP BY naics2, line")
def publication_table(spark, d):
    rows = table(spark, d, "analysis_panel").filter("ai_score between 1 and 3").groupBy("naics2", "ai_score").agg(F.avg("sale").alias("m"), (F.stddev_samp("sale") / F.sqrt(F.count("sale"))).alias("e")).filter("m is not null")
    marks = F.when((F.col("e") > 0) & (F.col("m") / F.col("e") > 2.5758), "***").when((F.col("e") > 0) & (F.col("m") / F.col("e") > 1.96), "**").otherwise("")
    return G.publication_rows(rows, "naics2", "ai_score", F.round("m", 2), F.round("e", 2), marks, ["1", "2", "3"], 2)


@add(E.oracle_sql()["did_l_unconditional"].replace("SELECT 'effect' AS kind, CAST(step AS INT) AS step,", "SELECT 'effect' AS kind, CAST(step AS INT) AS step, CAST(step - 1 AS INT) AS event_time,").replace("SELECT 'placebo', CAST(step AS INT),", "SELECT 'placebo', CAST(step AS INT), CAST(-step AS INT),"))
def did_event_times(spark, d):
    return G.event_times(E.did_l_unconditional(spark, d), "kind", "step")


@add(f"WITH {E._SAMPLE}, g AS (SELECT g, max(n_treated) AS n, avg(att) AS a FROM cells WHERE t >= g GROUP BY g) SELECT count(*) AS cohorts, CAST(sum(n) AS BIGINT) AS n_treated, round(sum(n * a) / sum(n), 6) AS att FROM g")
def att_overall(spark, d):
    return rounded(D.overall(D.by_cohort(D.att_gt(E._sample(spark, d)))))


@add()
def pretrend_test(spark, d):
    """Wald test of the effects before treatment; tested against NumPy."""
    wald = D.event_study(E._sample(spark, d))["wald"]
    return spark.createDataFrame([tuple(wald.values())] if wald else [], "statistic double, df int, p_value double")


# Scoring runs


def _stub():
    """A scorer for tests: the answer depends on the prompt's length alone, and a retry's on the same."""
    return lambda pairs: [(k, ["", "1", "2 or 3", "3", "2"][len(p) % 5]) for k, p in pairs]


_ANSWER = "CASE (length(snippet_text) + {}) % 5 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 2 END"
_FIRST, _RETRY = _ANSWER.format(979), _ANSWER.format(1063)


@add("SELECT snippet_id, length(snippet_text) + 979 AS prompt_chars, length(snippet_text) + 1063 AS retry_chars FROM snippets WHERE trim(snippet_text, ' ') <> ''")
def prompt_lengths(spark, d):
    rows = U.with_prompts(table(spark, d, "snippets").select("snippet_id", "snippet_text"), "snippet_text").filter("prompt is not null")
    return rows.select("snippet_id", F.char_length("prompt").cast("long").alias("prompt_chars"), F.char_length("retry_prompt").cast("long").alias("retry_chars"))


@add("SELECT record_id, trim(accession_number, ' ') AS accession_number, trim(cik, ' ') AS cik, coalesce(trim(form_type, ' '), '') AS form_type, 'run-9' AS run_id, 0 AS snippet_chars, 'not_called' AS parse_status, CAST(NULL AS INT) AS ai_score, FALSE AS llm_called FROM scored_filings")
def record_template(spark, d):
    rows = table(spark, d, "scored_filings").select("record_id", "accession_number", "cik", "form_type")
    return U.records(rows, {"run_id": "run-9"}).select("record_id", "accession_number", "cik", "form_type", "run_id", "snippet_chars", "parse_status", "ai_score", "llm_called")


_CHUNK = f"""SELECT *, CASE WHEN trim(coalesce(snippet_text, ''), ' ') = '' THEN 'empty_text' WHEN coalesce(keyword_hits, 0) = 0 THEN 'zero_no_keyword' ELSE 'call' END AS decision, {_FIRST} AS s1, {_RETRY} AS s2 FROM snippets WHERE year <= 2020"""


@add(f"""SELECT snippet_id, chunk_id, decision, CAST(CASE decision WHEN 'zero_no_keyword' THEN 1 WHEN 'call' THEN coalesce(s1, s2) END AS INT) AS ai_score, CASE WHEN decision <> 'call' THEN 'not_called' WHEN s1 IS NOT NULL THEN 'success' WHEN s2 IS NOT NULL THEN 'retry_success' ELSE 'failed' END AS parse_status,
    CASE WHEN decision <> 'call' THEN 0 WHEN s1 IS NOT NULL THEN 1 ELSE 2 END AS endpoint_attempts, CAST(coalesce(length(snippet_text), 0) AS INT) AS snippet_chars FROM ({_CHUNK})""")
def processed_chunks(spark, d):
    rows = table(spark, d, "snippets").select("snippet_id", "cik", "year", "chunk_id", "snippet_text", "keyword_hits")
    done = U.process_chunk(rows, "snippet_id", "snippet_text", "keyword_hits", _stub, settings={"run_id": "run-9"}, last_year=2020)
    return done.select("snippet_id", "chunk_id", "decision", "ai_score", "parse_status", "endpoint_attempts", "snippet_chars")


@add(f"""SELECT chunk_id, count(*) AS rows, count(*) FILTER (WHERE p = 'failed') AS failed, round(avg(s), 6) AS mean_score FROM (SELECT chunk_id, CASE WHEN decision = 'call' AND s1 IS NULL AND s2 IS NULL THEN 'failed' ELSE 'x' END AS p, CASE decision WHEN 'zero_no_keyword' THEN 1 WHEN 'call' THEN coalesce(s1, s2) END AS s FROM ({_CHUNK})) GROUP BY chunk_id""")
def processed_chunk_report(spark, d):
    rows = table(spark, d, "snippets").select("snippet_id", "cik", "year", "chunk_id", "snippet_text", "keyword_hits")
    done = U.process_chunk(rows, "snippet_id", "snippet_text", "keyword_hits", _stub, last_year=2020)
    state = F.when(F.col("parse_status") == "failed", "failed").otherwise("ok")
    return rounded(S.chunk_report(done.withColumn("state", state), "chunk_id", "state", "ai_score").select("chunk_id", "rows", "failed", "mean_score"))


@add(f"""SELECT chunk_id, count(*) AS rows, count(DISTINCT cik) AS firms, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year, count(*) FILTER (WHERE decision = 'empty_text') AS decision_empty_text, count(*) FILTER (WHERE decision = 'zero_no_keyword') AS decision_zero_no_keyword, count(*) FILTER (WHERE decision = 'call') AS decision_call,
    count(*) FILTER (WHERE decision = 'call') AS called, count(*) FILTER (WHERE decision = 'call' AND s1 IS NULL) AS retried, CAST(coalesce(sum(CASE WHEN decision = 'call' THEN CASE WHEN s1 IS NULL THEN 2 ELSE 1 END ELSE 0 END), 0) AS BIGINT) AS attempts, count(*) FILTER (WHERE decision = 'call' AND s1 IS NULL AND s2 IS NULL) AS state_failed,
    count(*) FILTER (WHERE sc = 1) AS score_1, count(*) FILTER (WHERE sc = 2) AS score_2, count(*) FILTER (WHERE sc = 3) AS score_3, count(*) FILTER (WHERE sc IS NULL) AS score_missing, round(avg(sc), 6) AS mean_score, round(avg(sc) FILTER (WHERE decision = 'call'), 6) AS mean_called_score, CAST(sum(keyword_hits) AS BIGINT) AS hits,
    CAST(sum(coalesce(length(snippet_text), 0)) AS BIGINT) AS chars, CAST(max(coalesce(length(snippet_text), 0)) AS INT) AS most_chars, count(*) FILTER (WHERE length(snippet_text) >= 2000) AS at_limit,
    CASE WHEN count(*) FILTER (WHERE decision = 'call' AND s1 IS NULL AND s2 IS NULL) = 0 THEN 'complete' WHEN count(*) FILTER (WHERE decision = 'call' AND s1 IS NULL AND s2 IS NULL) < count(*) FILTER (WHERE decision = 'call') THEN 'partial' ELSE 'failed' END AS state
    FROM (SELECT *, CASE decision WHEN 'zero_no_keyword' THEN 1 WHEN 'call' THEN coalesce(s1, s2) END AS sc FROM ({_CHUNK})) GROUP BY chunk_id""")
def chunk_summaries(spark, d):
    rows = table(spark, d, "snippets").select("snippet_id", "cik", "year", "chunk_id", "snippet_text", "keyword_hits")
    done = U.process_chunk(rows, "snippet_id", "snippet_text", "keyword_hits", _stub, last_year=2020, limit=2000)
    out = rounded(U.chunk_summary(done, "chunk_id"))
    return out.drop("decision_audit_call", "decision_call_without_keyword", "state_success", "state_retry_success", "state_not_called", "most_hits", "failure_share")


@add(f"WITH {_WIN} SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'skipped_valid' WHEN n > 0 THEN 'extracted' ELSE 'no_keyword' END AS state, CAST(CASE WHEN d.doc_id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS INT) AS windows FROM (SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^ -~]|[&<]')) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM uni GROUP BY doc_id) u USING (doc_id)")
def extraction_states(spark, d):
    """Plain texts, which reading as a document leaves as they are but for white space."""
    rows = table(spark, d, "documents").filter(~F.coalesce("text", F.lit("")).rlike("[^ -~]|[&<]"))
    return W.extraction_states(rows, "doc_id", "text", PLAIN, rows.filter("doc_id % 10 = 0")).select("doc_id", "state", "windows")


@add(f"""WITH {SQL_UNIQUE}, r AS (SELECT firm, ai_adoption_year AS g, CAST(year = ai_adoption_year AS INT) AS event FROM uniq WHERE ai_adoption_year IS NOT NULL AND (ai_adoption_year = 0 OR (ai_adoption_year >= 2016 AND year <= ai_adoption_year)))
    SELECT firm, CAST(sum(event) AS BIGINT) AS events FROM r GROUP BY firm HAVING sum(event) <> CAST(max(g) > 0 AS INT)""")
def event_faults(spark, d):
    return L.event_faults(L.risk_set(unique_panel(spark, d), "year", "ai_adoption_year", 2016), "firm", "ai_adoption_year")


_KEPT = ["TRUE", "firm IS NOT NULL AND year IS NOT NULL", "ai_adoption_year IS NOT NULL", "sale IS NOT NULL", "emp IS NOT NULL AND che IS NOT NULL", "(ai_adoption_year = 0 OR ai_adoption_year >= 2016)"]


@add(f"WITH {SQL_PANEL} " + " UNION ALL ".join(f"SELECT '{n}' AS step, count(*) AS rows, count(DISTINCT firm) AS firms FROM panel WHERE {' AND '.join(_KEPT[: i + 1])}" for i, n in enumerate(("all", "keys", "cohort", "outcome", "controls", "first_cohort"))))
def sample_losses(spark, d):
    return D.sample_loss(panel(spark, d), "firm", "year", "ai_adoption_year", "sale", ["emp", "che"], 2016)


_BAD = "coalesce(llm_processed, TRUE) AND coalesce(parse_status, '') NOT IN ('success', 'retry_success')"


@add(f"""SELECT snippet_id, CAST(CASE WHEN {_BAD} AND trim(snippet_text, ' ') <> '' THEN coalesce({_FIRST}, {_RETRY}, ai_score) ELSE ai_score END AS INT) AS ai_score,
    CASE WHEN {_BAD} AND trim(snippet_text, ' ') <> '' AND {_FIRST} IS NOT NULL THEN 'success' WHEN {_BAD} AND trim(snippet_text, ' ') <> '' AND {_RETRY} IS NOT NULL THEN 'retry_success' ELSE parse_status END AS parse_status FROM snippets""")
def repaired_scores(spark, d):
    done = table(spark, d, "snippets").withColumn("llm_called", F.col("llm_processed")).withColumn("profile", F.lit("p1"))
    return U.repaired(done, "snippet_id", "snippet_text", _stub, ["profile"]).select("snippet_id", "ai_score", "parse_status")


@add("""SELECT record_id, CASE WHEN parse_status = 'ok' THEN 'success' WHEN score_status = 'ok' THEN 'retry_success' WHEN ai_score IS NULL AND nullif(parse_status, 'failed') IS NULL THEN 'endpoint_error' WHEN ai_score IS NULL AND nullif(score_status, 'failed') IS NULL THEN 'retry_endpoint_error' ELSE 'failed' END AS state FROM scored_filings""")
def endpoint_states(spark, d):
    c = F.col
    error = F.when(c("ai_score").isNull(), F.lit("timeout"))
    return table(spark, d, "scored_filings").select("record_id", U.endpoint_state(F.nullif("parse_status", F.lit("failed")), F.nullif("score_status", F.lit("failed")), error).alias("state"))


# Gates


@add("SELECT extract_status, count(*) AS n FROM filing_manifest WHERE coalesce(extract_status, '') NOT IN ('extracted', 'no_keyword', 'skipped_valid') GROUP BY extract_status")
def incomplete_extractions(spark, d):
    return U.incomplete(table(spark, d, "filing_manifest"))


@add("""WITH l AS (SELECT chunk_id, count(*) AS n FROM scored_filings GROUP BY chunk_id), r AS (SELECT chunk_id, count(*) AS n FROM snippets GROUP BY chunk_id)
    SELECT coalesce(l.chunk_id, r.chunk_id) AS chunk_id, coalesce(l.n, -1) AS left_rows, coalesce(r.n, -1) AS right_rows, coalesce(l.n, -1) = coalesce(r.n, -1) AS same FROM l FULL JOIN r ON l.chunk_id = r.chunk_id""")
def output_parity(spark, d):
    return U.parity(table(spark, d, "scored_filings"), table(spark, d, "snippets"), "chunk_id")


_SEGMENTS = "w AS (SELECT accession_number || '|' || cik AS k, CAST(row_number() OVER (PARTITION BY accession_number, cik ORDER BY seg_position, segment_id) AS INT) + CAST(segment_id % 97 = 0 AS INT) AS i, text, CASE WHEN segment_id % 89 = 0 THEN 'no term' ELSE '' END AS t, CASE WHEN segment_id % 83 = 0 THEN '' ELSE sha256(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' ')) END AS h FROM segments), f AS (SELECT accession_number || '|' || cik AS k, count(*) + CAST(min(segment_id) % 7 = 0 AS INT) AS n FROM segments GROUP BY 1)"


@add(f"""WITH {_SEGMENTS}, a AS (SELECT k, count(*) AS m, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS d, count(*) FILTER (WHERE h <> '' IS FALSE AND text IS NOT NULL) AS bad, count(*) FILTER (WHERE t <> '' AND text IS NOT NULL AND NOT contains(lower(text), t)) AS gone FROM w GROUP BY k)
    SELECT * FROM (SELECT k, CASE WHEN n <> m THEN 'window count' WHEN lo <> 1 OR hi <> m OR d <> m THEN 'window numbers' WHEN bad > 0 THEN 'text hash' WHEN gone > 0 THEN 'missing term' END AS problem FROM f JOIN a USING (k)) WHERE problem IS NOT NULL""")
def result_problems(spark, d):
    """Segments stand for windows; counts, numbers, hashes and terms are falsified by rule."""
    from pyspark.sql import Window

    c = F.col
    rows = table(spark, d, "segments").withColumn("k", F.concat_ws("|", "accession_number", "cik"))
    number = F.row_number().over(Window.partitionBy("k").orderBy("seg_position", "segment_id")) + (c("segment_id") % 97 == 0).cast("int")
    digest = F.when(c("segment_id") % 83 == 0, "").otherwise(F.sha2(X.squish(c("text")), 256))
    windows = rows.select("k", number.alias("i"), "text", F.when(c("segment_id") % 89 == 0, "no term").otherwise("").alias("t"), digest.alias("h"))
    results = rows.groupBy("k").agg((F.count(F.lit(1)) + (F.min("segment_id") % 7 == 0).cast("int")).alias("n"))
    return M.validate_results(results, windows, "k", "n", "text", "h", "i", "t")


# Formats


@add("SELECT segment_id, trim(text, ' ') || chr(10) || 'x' || chr(10) || '1) The end.' AS lines FROM segments WHERE NOT regexp_matches(text, '[^ -~]') AND NOT regexp_matches(text, '  | \\| | ([0-9]{1,2}|[A-Za-z])\\) [A-Z]') AND trim(text, ' ') <> ''")
def structured_lines(spark, d):
    rows = table(spark, d, "segments").filter(~F.col("text").rlike("[^ -~]") & ~F.col("text").rlike(r"  | \| | ([0-9]{1,2}|[A-Za-z])\) [A-Z]") & (F.trim("text") != ""))
    return rows.select("segment_id", X.structured_text(F.concat(F.col("text"), F.lit("\r\n\t x  |  1) The end."))).alias("lines"))


@add("SELECT panel_id, round(CASE WHEN panel_id % 5 = 0 THEN NULL ELSE sale / 100 END, 8) AS share FROM (SELECT panel_id, round(sale, 2) AS sale FROM analysis_panel WHERE sale BETWEEN -99999 AND 99999)")
def percents(spark, d):
    text = F.when(F.col("panel_id") % 5 == 0, "S").otherwise(F.concat(F.format_string("%.2f", F.round("sale", 2)), F.lit("%")))
    return rounded(table(spark, d, "analysis_panel").filter("sale between -99999 and 99999").select("panel_id", X.parse_percent(text).alias("share")), 8)


@add("SELECT panel_id, CASE WHEN ni IS NULL THEN '' WHEN printf('%.1f', round(ni / 1000, 1)) = '-0.0' THEN '0.0' ELSE printf('%.1f', round(ni / 1000, 1)) END AS thousands, coalesce(regexp_replace(format('{:,}', CAST(round(csho, 0) AS BIGINT)), '^-0$', '0'), '') AS shares FROM analysis_panel")
def number_formats(spark, d):
    return table(spark, d, "analysis_panel").select("panel_id", X.fixed(F.round(F.col("ni") / 1000, 1), 1).alias("thousands"), X.grouped(F.round("csho", 0).cast("long")).alias("shares"))


@add("SELECT panel_id, coalesce(lower(trim(t, ' ')) IN ('true', '1', 'yes'), FALSE) AS truth FROM (SELECT panel_id, CASE panel_id % 7 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Yes ' WHEN 3 THEN 'no' WHEN 4 THEN '' WHEN 5 THEN '0' END AS t FROM analysis_panel)")
def truth_values(spark, d):
    spelled = F.expr("CASE panel_id % 7 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Yes ' WHEN 3 THEN 'no' WHEN 4 THEN '' WHEN 5 THEN '0' END")
    return table(spark, d, "analysis_panel").select("panel_id", X.truth(spelled).alias("truth"))


_PAGE = "concat('<html><head><style>p {}</style></head><body><p>', accession_number, '</p><div style=\"display: none\">hidden</div><table><tr><td>', form_type, '</td><td>', cast(year as string), '</td></tr></table><pre>a &lt; ', cik, '</pre></body></html>')"


@add("SELECT accession_number, cik, accession_number || chr(10) || form_type || ' ' || year || chr(10) || 'a < ' || cik AS text, 'ok' AS status FROM filing_manifest")
def html_pages(spark, d):
    rows = table(spark, d, "filing_manifest").withColumn("page", F.expr(_PAGE))
    found = W.html_to_text(rows, ["accession_number", "cik"], "page")
    return found.select("accession_number", "cik", F.regexp_replace("text", r" *\n+ *", "\n").alias("text"), "status")


@add("SELECT accession_number, cik, CAST(0 AS INT) AS block, 'a < ' || cik AS block_text FROM filing_manifest")
def preformatted_blocks(spark, d):
    return W.pre_blocks(table(spark, d, "filing_manifest").withColumn("page", F.expr(_PAGE)), ["accession_number", "cik"], "page")


@add("SELECT accession_number, cik, CASE WHEN form_type = '10-K' THEN 'body of ' || cik END AS body FROM filing_manifest")
def submission_documents(spark, d):
    payload = F.expr("concat('<DOCUMENT>\n<TYPE>EX-1\n<TEXT>no</TEXT></DOCUMENT>\n<document><type> ', form_type, '\n<TEXT>body of ', cik, '</TEXT></document><DOCUMENT><TYPE>', form_type, '\n<TEXT>later</TEXT></DOCUMENT>')")
    return W.submission_bodies(table(spark, d, "filing_manifest").withColumn("p", payload), ["accession_number", "cik"], "p", "10-k")


@add("""SELECT accession_number, cik, form_type, year FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY cik, form_type, filed, p) AS r FROM (
    SELECT accession_number, cik, form_type, filed, CAST(regexp_extract(coalesce(nullif(regexp_extract(rep, '^([0-9]{4})-', 1), ''), filed), '^([0-9]{4})', 1) AS INT) AS year, p FROM (
        SELECT accession_number, cik, form_type, printf('%d-01-02', filing_year) AS filed, CASE WHEN report_year IS NULL THEN '' ELSE printf('%d-01-03', report_year) END AS rep, row_number() OVER (PARTITION BY cik ORDER BY accession_number, form_type, filing_year, report_year NULLS FIRST) - 1 AS p FROM (SELECT DISTINCT accession_number, cik, form_type, filing_year, report_year FROM filing_manifest)))
    WHERE form_type IN ('10-K', '10-K/A') AND year IN (SELECT DISTINCT year FROM filing_manifest m WHERE m.year >= 2012)) WHERE r = 1""")
def manifest_from_json(spark, d):
    """Filings go into one JSON document of parallel arrays per firm and come back as manifest rows."""
    rows = table(spark, d, "filing_manifest").select("accession_number", "cik", "form_type", "filing_year", "report_year").distinct()
    item = F.struct("accession_number", "form_type", "filing_year", "report_year")
    firms = rows.groupBy("cik").agg(F.array_sort(F.collect_list(item)).alias("l"))
    field = lambda f: F.transform("l", f)
    recent = F.struct(
        field(lambda x: x["accession_number"]).alias("accessionNumber"), field(lambda x: x["form_type"]).alias("form"), field(lambda x: F.format_string("%d-01-02", x["filing_year"])).alias("filingDate"),
        field(lambda x: F.when(x["report_year"].isNull(), "").otherwise(F.format_string("%d-01-03", x["report_year"]))).alias("reportDate"),
    )
    documents = firms.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    years = table(spark, d, "filing_manifest").filter("year >= 2012").select("year").distinct()
    lookup = firms.select("cik").join(F.broadcast(years))  # firms times the few years asked for
    found = M.build_manifest(M.rows_of_columns(documents, "cik", "payload"), lookup, ["10-K", "10-K/A"])
    return found.select(F.col("accessionNumber").alias("accession_number"), "cik", F.col("form").alias("form_type"), "year")


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
