"""Queries of the training-data operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.keys import accession_key, annual_form, firm_key
from panelwright.llm.encode import count_tokens, encode_corpus, word_counts
from panelwright.llm.language import identify, issues
from panelwright.llm.mixing import mix_plan, mix_report, mix_sources
from panelwright.llm.near import near_duplicates
from panelwright.llm.responses import defects
from panelwright.llm.split import split_items
from panelwright.llm.survivors import best_fields, best_record
from panelwright.session import cut


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark: SparkSession, sf_dir: str):
    """Scored records with their trust rank, keys and usable values."""
    sources = _read(spark, sf_dir, "score_sources").select("source_label", "trust_rank")
    records = _read(spark, sf_dir, "scored_filings").join(sources, "source_label", "left")
    keys = {"cik": firm_key(F.col("cik")), "accession_number": accession_key(F.col("accession_number"))}
    usable = {
        "form_type": annual_form(F.col("form_type")),
        "ai_score": F.when(F.col("ai_score").between(1, 3), F.col("ai_score")),
        "year": F.when(F.col("year").between(1993, 2027), F.col("year")),
    }
    rank = {"trust": F.col("trust_rank"), "recency": F.col("scored_at"), "tie": F.col("record_id")}
    return records, keys, usable, rank


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, keys, usable, rank = _scored(spark, sf_dir)
    return best_fields(records, keys, usable=usable, **rank)


def p2_best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, keys, usable, rank = _scored(spark, sf_dir)
    keyed = records.withColumns({f"key_{k}": c for k, c in keys.items()})
    return best_record(keyed, [f"key_{k}" for k in keys], usable=usable, **rank).select("key_cik", "key_accession_number", "record_id", "source_label")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _read(spark, sf_dir, "segments").select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), "text", F.lit(900).alias("most"))
    snippets = _read(spark, sf_dir, "snippets").select(F.lit("snippet").alias("kind"), F.col("snippet_id").alias("id"), F.col("snippet_text").alias("text"), F.col("max_prompt_chars").alias("most"))
    return split_items(segments.unionByName(snippets), kind=F.col("kind"), item_id=F.col("id"), text=F.col("text"), limit=F.col("most"), overlap=90)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).filter("piece = 1").select("kind", "item_id", "boundary")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return encode_corpus(documents, frequent=word_counts(documents, least=2, known=False))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(count_tokens(_read(spark, sf_dir, "documents"), keep=["doc_id", "source"]), "sizes")
    plan = cut(mix_plan(sizes, _read(spark, sf_dir, "mix_plans")), "plan")
    return plan, mix_sources(sizes, plan)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(*_mixed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_shares(spark, sf_dir).filter("exhausted").select("plan_id", "source")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "responses").select("response_id", "prompt", "raw_response", "score_explanation")
    return defects(pairs, row_id="response_id", prompt=F.col("prompt"), raw=F.col("raw_response"), explanation=F.col("score_explanation"))


def _near(spark: SparkSession, sf_dir: str):
    for table, id_col, field in (("anchors", "anchor_id", "anchor_text"), ("snippets", "snippet_id", "snippet_text")):
        yield field, near_duplicates(_read(spark, sf_dir, table).select(id_col, field), id_col, field, similarity=0.75, least_words=8)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [near.all_pairs().select(F.lit(field).alias("field"), "id_a", "id_b") for field, near in _near(spark, sf_dir)]
    return found[0].unionByName(found[1])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [near.per_text().withColumn("field", F.lit(field)) for field, near in _near(spark, sf_dir)]
    return found[0].unionByName(found[1])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(_languages(spark, sf_dir), "doc_id")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_best_record": p2_best_record, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_languages": p8_languages, "p7_mix": p7_mix, "p7_shares": p7_shares}


_CIK = "regexp_replace(regexp_replace(regexp_replace(cik, '\\.0+([^0-9]*)$', '\\1'), '[^0-9]', '', 'g'), '^0+(.)', '\\1')"
_DIGITS = "regexp_replace(regexp_replace(accession_number, '^.*/', ''), '[^0-9]', '', 'g')"
_FORM = "regexp_replace(regexp_replace(upper(form_type), '[^A-Z0-9]', '', 'g'), '^FORM', '')"
_SCORED = f"""
WITH keyed AS (
    SELECT {_CIK} AS k, {_DIGITS} AS dg, {_FORM} AS fm, s.*, t.trust_rank
    FROM scored_filings s LEFT JOIN score_sources t USING (source_label)
), ready AS (
    SELECT k AS cik, lpad(dg, 18, '0') AS a, record_id, scored_at, trust_rank, source_label,
           CASE fm WHEN '10K' THEN '10-K' WHEN '10KA' THEN '10-K/A' END AS form_type,
           CASE WHEN ai_score BETWEEN 1 AND 3 THEN ai_score END AS ai_score,
           CASE WHEN year BETWEEN 1993 AND 2027 THEN year END AS year
    FROM keyed WHERE k <> '' AND length(dg) BETWEEN 1 AND 18
), named AS (
    SELECT cik, substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) AS accession_number, * EXCLUDE (cik, a) FROM ready
)
"""


# Word sets of at least eight words per field, and pairs of classes of equal sets with a similarity of 0.75 or more.
_SETS = """
w AS (SELECT 'anchor_text' AS field, anchor_id AS id, list_sort(list_distinct(regexp_extract_all(lower(anchor_text), '[a-z0-9]+'))) AS s FROM anchors
      UNION ALL SELECT 'snippet_text', snippet_id, list_sort(list_distinct(regexp_extract_all(lower(snippet_text), '[a-z0-9]+'))) FROM snippets),
m AS (SELECT field, id, s, len(s) AS n, min(id) OVER (PARTITION BY field, s) AS rep, count(*) OVER (PARTITION BY field, s) AS copies FROM w WHERE len(s) >= 8),
c AS (SELECT field, id, s, n FROM m WHERE id = rep),
p AS (SELECT a.field, a.id AS a, b.id AS b FROM c a JOIN c b ON a.field = b.field AND a.id < b.id AND b.n BETWEEN 0.75 * a.n AND a.n / 0.75 WHERE len(list_intersect(a.s, b.s)) >= 0.75 * (a.n + b.n - len(list_intersect(a.s, b.s))))"""
_PAIRS = f"""WITH {_SETS} SELECT a.field, a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.field = b.field AND a.rep = b.rep AND a.id < b.id
    UNION ALL SELECT p.field, least(x.id, y.id), greatest(x.id, y.id) FROM p JOIN m x ON x.field = p.field AND x.rep = p.a JOIN m y ON y.field = p.field AND y.rep = p.b"""
_GROUPS = f"""WITH {_SETS}, l AS (SELECT field, rep, count(*) AS links FROM (SELECT field, a AS rep FROM p UNION ALL SELECT field, b FROM p) GROUP BY field, rep)
    SELECT m.id, m.rep AS class_id, m.copies, coalesce(l.links, 0) AS links, m.field FROM m LEFT JOIN l ON l.field = m.field AND l.rep = m.rep"""

_WS = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_BREAK = "\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}"


def _longest(marks: str | None) -> str:
    """Length of the longest part when text is cut at white space after marks and at line breaks, or at any white space."""
    cut_text = f"regexp_replace(text, '[{_WS}]+', chr(1), 'g')"
    if marks:
        cut_text = f"regexp_replace(regexp_replace(text, '([{marks}])[{_WS}]+', '\\1' || chr(1), 'g'), '[{_WS}]*[{_BREAK}][{_WS}]*', chr(1), 'g')"
    return f"list_max(list_transform(string_split({cut_text}, chr(1)), lambda x: length(regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g'))))"


_OVERSIZED = f"""SELECT kind, item_id, CASE WHEN {_longest('.!?;')} <= most THEN 'sentence' WHEN {_longest('.!?;,|:')} <= most THEN 'clause' WHEN {_longest(None)} <= most THEN 'space' ELSE 'none' END AS boundary
    FROM (SELECT 'segment' AS kind, segment_id AS item_id, text, 900 AS most FROM segments UNION ALL SELECT 'snippet', snippet_id, snippet_text, max_prompt_chars FROM snippets) WHERE most > 0 AND length(text) > most"""


def oracle_sql() -> dict[str, str]:
    ranked = ", ".join(
        f"row_number() OVER (PARTITION BY cik, accession_number ORDER BY ({f} IS NULL), trust_rank NULLS LAST, scored_at DESC NULLS LAST, record_id DESC) AS r_{f}"
        for f in ("form_type", "ai_score", "year")
    )
    return {
        "p4_found": _PAIRS, "p4_groups": _GROUPS, "p5_found": _OVERSIZED,
        "p2_found": f"""{_SCORED}, ranked AS (SELECT *, {ranked} FROM named)
            SELECT cik, accession_number, max(CASE WHEN r_form_type = 1 THEN form_type END) AS form_type,
                   max(CASE WHEN r_ai_score = 1 THEN ai_score END) AS ai_score, max(CASE WHEN r_year = 1 THEN year END) AS year
            FROM ranked GROUP BY cik, accession_number HAVING count(*) >= 2""",
        "p2_best_record": f"""{_SCORED}, ranked AS (
                SELECT *, row_number() OVER (PARTITION BY cik, accession_number
                    ORDER BY (CAST(form_type IS NOT NULL AS INT) + CAST(ai_score IS NOT NULL AS INT) + CAST(year IS NOT NULL AS INT)) DESC,
                             trust_rank NULLS LAST, scored_at DESC NULLS LAST, record_id DESC) AS r FROM named)
            SELECT cik AS key_cik, accession_number AS key_accession_number, record_id, source_label FROM ranked WHERE r = 1""",
    }
