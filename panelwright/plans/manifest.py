"""Queries on manifests: coverage, progress, batches, chunks, samples and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.operators import manifest as M
from panelwright.plans.common import SQL_FILINGS, Registry, filings, panel, sql_key, table

registry = Registry()
add = registry.add

_PROGRESS = ["download_status", "download_bytes", "extract_status", "window_count"]


@add(f"""WITH {SQL_FILINGS}, k AS (SELECT DISTINCT {sql_key('cik')} AS firm, year FROM analysis_panel WHERE {sql_key('cik')} IS NOT NULL AND year IS NOT NULL), c AS (SELECT firm, year, count(*) FILTER (WHERE form_type = '10-K') AS a, count(*) FILTER (WHERE form_type = '10-K/A') AS b FROM filings GROUP BY firm, year)
    SELECT k.firm, k.year, coalesce(a, 0) AS form_10k_count, coalesce(b, 0) AS form_10ka_count, coalesce(a + b, 0) AS filing_count, coalesce(a + b, 0) > 0 AS has_matching_filing FROM k LEFT JOIN c ON k.firm = c.firm AND k.year = c.year""")
def metadata_coverage(spark, d):
    lookup = panel(spark, d).filter("firm is not null and year is not null")
    return M.coverage(lookup, filings(spark, d), ["firm", "year"], "form_type", {"form_10k_count": "10-K", "form_10ka_count": "10-K/A"})


_SPLIT = f"{SQL_FILINGS}, fresh AS (SELECT DISTINCT firm, accession_number, CASE WHEN year % 5 = 0 THEN source_url || '?v=2' ELSE source_url END AS source_url, 'pending' AS download_status, CAST(NULL AS BIGINT) AS download_bytes, 'pending' AS extract_status, CAST(NULL AS INT) AS window_count FROM filings)"


@add(f"""WITH {_SPLIT}, prev AS (SELECT * FROM (SELECT firm, accession_number, source_url, {', '.join(_PROGRESS)}, row_number() OVER (PARTITION BY firm, accession_number ORDER BY extract_updated_at DESC NULLS LAST, source_url DESC NULLS LAST, {', '.join(c + ' DESC NULLS LAST' for c in _PROGRESS)}) AS r FROM filings) WHERE r = 1)
    SELECT f.firm, f.accession_number, f.source_url, {', '.join(f"CASE WHEN p.source_url = f.source_url THEN p.{c} ELSE f.{c} END AS {c}" for c in _PROGRESS)} FROM fresh f LEFT JOIN prev p ON f.firm = p.firm AND f.accession_number = p.accession_number""")
def manifest_progress_merge(spark, d):
    previous = filings(spark, d).select("firm", "accession_number", "source_url", "extract_updated_at", *_PROGRESS)
    url = F.when(F.col("year") % 5 == 0, F.concat(F.col("source_url"), F.lit("?v=2"))).otherwise(F.col("source_url"))
    fresh = filings(spark, d).select("firm", "accession_number", url.alias("source_url"), F.lit("pending").alias("download_status"), F.lit(None).cast("long").alias("download_bytes"), F.lit("pending").alias("extract_status"), F.lit(None).cast("int").alias("window_count")).distinct()
    return M.carry_progress(fresh, previous, ["firm", "accession_number"], "source_url", _PROGRESS, "extract_updated_at")


@add(f"""WITH {SQL_FILINGS}, o AS (SELECT firm, accession_number, source_url, download_bytes, extract_updated_at, processing_batch, coalesce(sum(coalesce(download_bytes, 0)) OVER (PARTITION BY processing_batch ORDER BY accession_number, cik, source_url, extract_updated_at, filing_date, extract_status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM filings WHERE processing_batch IS NOT NULL)
    SELECT processing_batch, count(*) AS n, CAST(max(b) AS BIGINT) AS most_before FROM o WHERE b < 50000000 GROUP BY processing_batch""")
def storage_batches_prefix(spark, d):
    order = [F.col(c).asc_nulls_last() for c in ("accession_number", "cik", "source_url", "extract_updated_at", "filing_date", "extract_status")]
    rows = M.next_batch(filings(spark, d).filter("processing_batch is not null"), "processing_batch", order, "download_bytes", 50_000_000)
    return rows.groupBy("processing_batch").agg(F.count(F.lit(1)).alias("n"), F.max("bytes_before").alias("most_before"))


@add("""WITH RECURSIVE o AS (SELECT processing_batch, accession_number, source_url, download_bytes, coalesce(download_bytes, 0) AS w, row_number() OVER (PARTITION BY processing_batch ORDER BY accession_number, source_url, download_bytes NULLS FIRST) AS i FROM filing_manifest WHERE processing_batch IS NOT NULL),
    r AS (SELECT o.*, w AS used, 1 AS batch FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN r.used >= 50000000 THEN o.w ELSE r.used + o.w END, CASE WHEN r.used >= 50000000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN o ON o.processing_batch = r.processing_batch AND o.i = r.i + 1)
    SELECT processing_batch, accession_number, source_url, download_bytes, CAST(batch AS INT) AS batch FROM r""")
def storage_batches_all(spark, d):
    """Greedy batches of every store."""
    rows = table(spark, d, "filing_manifest").filter("processing_batch is not null").select("processing_batch", "accession_number", "source_url", "download_bytes")
    return M.storage_batches(rows, "processing_batch", ["accession_number", "source_url", "download_bytes"], "download_bytes", 50_000_000)


@add("WITH u AS (SELECT DISTINCT accession_number FROM segments WHERE accession_number IS NOT NULL), n AS (SELECT accession_number, CAST((row_number() OVER (ORDER BY accession_number) - 1) // 100 + 1 AS INT) AS chunk_id FROM u) SELECT segment_id, chunk_id FROM segments LEFT JOIN n USING (accession_number)")
def chunk_assignment(spark, d):
    return M.chunk_numbers(table(spark, d, "segments"), "accession_number", 100).select("segment_id", "chunk_id")


@add()
def stratified_sample(spark, d):
    """Quotas by largest remainder; tested against a plain loop."""
    rows = table(spark, d, "filing_manifest").dropDuplicates(["cik", "accession_number"]).withColumn("row_id", F.concat_ws("|", "cik", "accession_number"))
    return M.stratified_sample(rows, "form_type", "year", "row_id", 300, "sample-1").select("cik", "accession_number", "form_type", "year")


@add()
def unseen_firm_sample(spark, d):
    """The same with firms not chosen before first; tested against a plain loop."""
    rows = table(spark, d, "filing_manifest").groupBy("cik", "accession_number").agg(F.min("form_type").alias("form_type"), F.min("year").alias("year")).withColumn("row_id", F.concat_ws("|", "cik", "accession_number"))
    return M.stratified_sample(rows, "form_type", "year", "row_id", 300, "sample-1", unit="cik")


@add("WITH p AS (SELECT cik, min(filing_year) AS a, max(filing_year) AS b FROM filing_manifest GROUP BY cik) SELECT cik, a || '-01-01' AS first, b || '-12-31' AS last FROM p WHERE (a <= 2006 AND b >= 2006) OR (a <= 2023 AND b >= 2023)")
def relevant_pages(spark, d):
    pages = table(spark, d, "filing_manifest").groupBy("cik").agg(F.concat(F.min("filing_year"), F.lit("-01-01")).alias("first"), F.concat(F.max("filing_year"), F.lit("-12-31")).alias("last"))
    return M.relevant_pages(pages, spark.createDataFrame([(2006,), (2023,)], "year int"), "first", "last", "filing_date")


@add("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.1 AS chosen FROM documents")
def stable_hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", (X.hash_fraction(F.col("doc_id").cast("string")) < 0.1).alias("chosen"))


@add("SELECT DISTINCT accession_number, cik FROM filing_manifest m WHERE NOT EXISTS (SELECT 1 FROM (SELECT accession_number, cik, extraction_version FROM filing_manifest WHERE extract_status IN ('extracted', 'no_keyword', 'skipped_valid')) r WHERE r.accession_number = m.accession_number AND r.cik = m.cik AND r.extraction_version = 'v1.4')")
def incremental_antijoin(spark, d):
    manifest = table(spark, d, "filing_manifest").select("accession_number", "cik", F.lit("v1.4").alias("extraction_version")).distinct()
    done = table(spark, d, "filing_manifest").filter(F.col("extract_status").isin("extracted", "no_keyword", "skipped_valid")).select("accession_number", "cik", "extraction_version")
    return M.pending(manifest, done, ["accession_number", "cik"], ["extraction_version"]).select("accession_number", "cik")


@add("""SELECT count(*) AS rows, count(DISTINCT accession_number) AS accessions, count(DISTINCT cik) AS firms, count(*) FILTER (WHERE form_type = '10-K') AS originals, count(*) FILTER (WHERE form_type = '10-K/A') AS amendments, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year,
    count(*) FILTER (WHERE download_status = 'downloaded') AS downloaded, count(*) FILTER (WHERE download_status = 'failed') AS download_failed, CAST(sum(download_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE extract_status = 'extracted') AS extracted,
    count(*) FILTER (WHERE extract_status = 'no_keyword') AS without_keyword, count(*) FILTER (WHERE extract_status = 'failed') AS extract_failed, CAST(sum(window_count) AS BIGINT) AS windows, CAST(sum(keyword_hit_count) AS BIGINT) AS hits, CAST(sum(exact_duplicate_windows_removed) AS BIGINT) AS duplicates_removed,
    count(*) FILTER (WHERE coalesce(trim(report_date), '') <> '') AS with_report_date, count(*) FILTER (WHERE coalesce(trim(filing_date), '') <> '') AS with_filing_date, count(*) FILTER (WHERE coalesce(trim(raw_deleted_at), '') <> '') AS purged FROM filing_manifest""")
def manifest_report(spark, d):
    return M.manifest_report(table(spark, d, "filing_manifest"))


@add(f"""WITH {SQL_FILINGS} SELECT DISTINCT accession_number, firm, filed, period FROM filings""")
def manifest_dates(spark, d):
    return filings(spark, d).select("accession_number", "firm", "filed", "period").distinct()


_BASE = "https://filings.example.org/archive"


@add(f"""SELECT DISTINCT accession_number, cik, CASE WHEN coalesce(trim(primary_document), '') <> '' THEN '{_BASE}/' || cik || '/' || replace(accession_number, '-', '') || '/' || trim(primary_document) ELSE '{_BASE}/' || cik || '/' || replace(accession_number, '-', '') || '/' || accession_number || '.txt' END AS url,
    CASE WHEN lower(regexp_extract(primary_document, '\\.([A-Za-z0-9]+)$', 1)) IN ('htm', 'html', 'txt', 'xml', 'xhtml') THEN lower(regexp_extract(primary_document, '\\.([A-Za-z0-9]+)$', 1)) ELSE 'htm' END AS extension FROM filing_manifest""")
def filing_addresses(spark, d):
    c = F.col
    return table(spark, d, "filing_manifest").select("accession_number", "cik", X.filing_url(_BASE, c("cik"), c("accession_number"), c("primary_document")).alias("url"), X.safe_extension(c("primary_document")).alias("extension")).distinct()


@add("SELECT doc_id, coalesce(strlen(text) >= 200 AND NOT contains(lower(substr(text, 1, 131072)), 'controls over') AND NOT contains(lower(substr(text, 1, 131072)), 'nothing but an error'), FALSE) AS ok FROM documents")
def payload_check(spark, d):
    return table(spark, d, "documents").select("doc_id", X.payload_ok(F.col("text"), ["controls over", "nothing but an error"]).alias("ok"))


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
