"""Queries on texts: sentences, lexicon windows, evidence, audit and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.operators import audit as A
from panelwright.operators import evidence as E
from panelwright.operators import paths as H
from panelwright.operators import scoring as S
from panelwright.operators import text as W
from panelwright.operators.lexicon import DEFAULT_TERMS
from panelwright.plans.common import Registry, table

registry = Registry()
add = registry.add

#: The lexicon without the terms whose patterns need lookarounds, which the SQL engine lacks. Those are in the queries named *_full.
PLAIN = [t for t in DEFAULT_TERMS if "(?<" not in t.pattern]
_WORDS = "|".join(t.pattern if t.exact_case else f"(?i:{t.pattern})" for t in PLAIN)

#: White space in the SQL engine's regular expressions, and as characters to trim.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = r"(^{0}+|{0}+$)".format(_WS)

_SENT = rf"""docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS sentence, s FROM (SELECT doc_id, i, regexp_replace(p, '{_TRIM}', '', 'g') AS s FROM (
    SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;]["'')\]]*[ \t]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM docs))) WHERE s <> '')"""


@add(f"WITH {_SENT} SELECT doc_id, sentence, s AS sentence_text FROM sent")
def sentence_spans(spark, d):
    return W.sentence_spans(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "sentence", "sentence_text")


@add(f"WITH {_SENT}, h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORDS}')) AS matched FROM docs) SELECT doc_id, matched, count(*) AS n FROM h GROUP BY doc_id, matched")
def lexicon_hits(spark, d):
    return W.lexicon_hits(table(spark, d, "documents"), ["doc_id"], "text", PLAIN).groupBy("doc_id", "matched").agg(F.count(F.lit(1)).alias("n"))


# Matches that don't cross a sentence boundary, which the plain words can't.
_WIN = f"""{_SENT}, hit AS (SELECT doc_id, sentence, len(regexp_extract_all(s, '{_WORDS}')) AS n FROM sent), lastn AS (SELECT doc_id, max(sentence) AS m FROM sent GROUP BY doc_id),
iv AS (SELECT h.doc_id, greatest(sentence - 1, 0) AS a, least(sentence + 1, m) AS b FROM hit h JOIN lastn USING (doc_id) WHERE n > 0),
isl AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER (PARTITION BY doc_id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS nw FROM iv)) GROUP BY doc_id, g),
win AS (SELECT i.doc_id, a, b, string_agg(s, ' ' ORDER BY sentence) AS t, CAST(sum(n) AS INT) AS n FROM isl i JOIN sent USING (doc_id) JOIN hit USING (doc_id, sentence) WHERE sentence BETWEEN a AND b GROUP BY i.doc_id, a, b),
uni AS (SELECT doc_id, min(a) AS a, CAST(sum(n) AS INT) AS n, CAST(count(*) AS INT) AS occ, arg_min(t, a) AS t, sha256(trim(regexp_replace(arg_min(t, a), '{_WS}+', ' ', 'g'), ' ')) AS h FROM win GROUP BY doc_id, trim(regexp_replace(t, '{_WS}+', ' ', 'g'), ' '))"""


@add(f"WITH {_WIN} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS INT) AS window_id, CAST(a AS INT) AS sentence_start, n AS keyword_hit_count, t AS window_text, h AS text_sha256, occ AS duplicate_occurrences FROM uni")
def keyword_windows(spark, d):
    return W.keyword_windows(table(spark, d, "documents"), ["doc_id"], "text", PLAIN, 1).select("doc_id", "window_id", "sentence_start", "keyword_hit_count", "window_text", "text_sha256", "duplicate_occurrences")


@add(f"WITH {_WIN} SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS windows FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM uni GROUP BY doc_id) u USING (doc_id)")
def no_hit_sentinels(spark, d):
    rows = W.with_sentinels(table(spark, d, "documents"), ["doc_id"], "text", PLAIN, 1)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("window_id") > 0).alias("windows"))


@add(f"WITH {_WIN} SELECT doc_id, string_agg(trim(t), E'\\n\\n' ORDER BY a) AS combined_text, CAST(length(string_agg(trim(t), E'\\n\\n' ORDER BY a)) AS INT) AS combined_chars FROM uni GROUP BY doc_id")
def windows_to_filing(spark, d):
    return W.join_texts(W.keyword_windows(table(spark, d, "documents"), ["doc_id"], "text", PLAIN, 1), ["doc_id"], "window_text", ["window_id"])


@add()
def lexicon_hits_full(spark, d):
    """The SQL engine lacks lookarounds; tested by brute force."""
    return W.lexicon_hits(table(spark, d, "documents"), ["doc_id"], "text", DEFAULT_TERMS).groupBy("doc_id", "term", "matched").agg(F.count(F.lit(1)).alias("n"))


@add()
def keyword_windows_full(spark, d):
    """As lexicon_hits_full."""
    return W.keyword_windows(table(spark, d, "documents"), ["doc_id"], "text", DEFAULT_TERMS, 1)


@add()
def no_hit_sentinels_full(spark, d):
    """As lexicon_hits_full."""
    rows = W.with_sentinels(table(spark, d, "documents"), ["doc_id"], "text", DEFAULT_TERMS, 1)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("window_id") > 0).alias("windows"))


@add()
def windows_to_filing_full(spark, d):
    """As lexicon_hits_full."""
    return W.join_texts(W.keyword_windows(table(spark, d, "documents"), ["doc_id"], "text", DEFAULT_TERMS, 1), ["doc_id"], "window_text", ["window_id"])


@add("""WITH iv AS (SELECT accession_number, cik, seg_position AS a, seg_position + 1 AS b FROM segments WHERE text LIKE '%intelligence%' AND seg_position IS NOT NULL), f AS (SELECT *, CASE WHEN a > max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM iv WINDOW w AS (PARTITION BY accession_number, cik ORDER BY a, b)),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY accession_number, cik ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT accession_number, cik, CAST(min(a) AS INT) AS a, CAST(max(b) AS INT) AS b, count(*) AS n_intervals FROM g GROUP BY accession_number, cik, k""")
def merged_intervals(spark, d):
    rows = table(spark, d, "segments").filter("text like '%intelligence%' and seg_position is not null").select("accession_number", "cik", F.col("seg_position").alias("a"), (F.col("seg_position") + 1).alias("b"))
    return H.merge_intervals(rows, ["accession_number", "cik"], "a", "b", 1)


@add("SELECT segment_id, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS \"after\" FROM segments WINDOW w AS (PARTITION BY accession_number, cik ORDER BY seg_position, segment_id)")
def neighbour_context(spark, d):
    return W.neighbours(table(spark, d, "segments"), ["accession_number", "cik"], ["seg_position", "segment_id"], "text").select("segment_id", "before", "after")


@add("WITH f AS (SELECT accession_number, cik, trim(text, ' ') AS t, min((seg_position, segment_id)) AS o FROM segments WHERE trim(text, ' ') <> '' GROUP BY 1, 2, 3) SELECT accession_number, cik, string_agg(t, E'\\n\\n' ORDER BY o, t) AS combined_text, CAST(length(string_agg(t, E'\\n\\n' ORDER BY o, t)) AS INT) AS combined_chars FROM f GROUP BY 1, 2")
def segments_to_filing(spark, d):
    return W.join_texts(table(spark, d, "segments"), ["accession_number", "cik"], "text", ["seg_position", "segment_id"])


@add("""SELECT anchor_id, CAST(row_number() OVER (PARTITION BY accession_number, cik ORDER BY quality_band DESC, total_score DESC, keyword_weight DESC, routing_weight DESC, length(anchor_text) DESC, seg_position, anchor_id) AS INT) AS rank FROM anchors""")
def ranked_anchors(spark, d):
    order = E.rank_of(F.col("quality_band"), F.col("total_score"), F.col("keyword_weight"), F.col("routing_weight"), F.col("anchor_text"), F.col("seg_position"), F.col("anchor_id"))
    w = Window.partitionBy("accession_number", "cik").orderBy(*order)
    return table(spark, d, "anchors").select("anchor_id", F.row_number().over(w).alias("rank"))


@add()
def routed_matches(spark, d):
    """Context rules need lookarounds that the SQL engine lacks; tested on fixtures."""
    return W.lexicon_hits(table(spark, d, "snippets"), ["snippet_id"], "snippet_text", DEFAULT_TERMS, routed=True)


@add()
def anchor_candidates(spark, d):
    return E.anchors(table(spark, d, "segments"), ["segment_id"], "text", DEFAULT_TERMS)


@add()
def evidence_snippets(spark, d):
    return E.snippets(table(spark, d, "documents"), ["doc_id"], "text", DEFAULT_TERMS, 1200, 1)


@add()
def readable_documents(spark, d):
    return W.html_to_text(table(spark, d, "documents"), ["doc_id"], "text")


_PATTERNS = {
    "strong": r"(?i)\b(artificial intelligence|machine learning|speech recognition|computer vision)\b", "broad": r"(?i)\b(predictive models|algorithms)\b", "operational": r"(?i)\b(use|uses|used|deploy|automate|supports?|production)\b",
    "first_person": r"(?i)\b(we|our|company|platforms?)\b", "low_value": r"(?i)\b(risk|may|could|plan|competition)\b", "adoption": r"(?i)\b(uses|embeds|applies)\b.{0,60}\b(artificial intelligence|machine learning|speech recognition)\b", "market": r"(?i)\b(market|customers|industry)\b",
}
_AUDIT = f"clean AS (SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' ') AS t FROM documents)," + r"""
sent AS (SELECT doc_id, CAST(i - 1 AS INT) AS sentence_index, trim(p, ' ') AS s FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS ps FROM clean))),
w AS (SELECT *, concat_ws(' ', lag(s) OVER v, s, lead(s) OVER v) AS win FROM sent WINDOW v AS (PARTITION BY doc_id ORDER BY sentence_index)),
c AS (SELECT *, """ + ", ".join(f"len(regexp_extract_all(win, '{_PATTERNS[p]}')) AS {p}_h" for p in ("strong", "broad", "operational", "first_person", "low_value")) + f", regexp_matches(win, '{_PATTERNS['adoption']}') AS ad, regexp_matches(win, '{_PATTERNS['market']}') AS mk FROM w WHERE regexp_matches(s, '{_PATTERNS['strong']}') OR regexp_matches(s, '{_PATTERNS['broad']}')), " + """
l AS (SELECT *, CAST(4 * (strong_h > 0)::INT + (broad_h > 0)::INT + 2 * (operational_h > 0)::INT + (first_person_h > 0)::INT + 3 * ad::INT - mk::INT - least(low_value_h, 2) AS INT) AS score,
    CASE WHEN ad AND first_person_h > 0 AND low_value_h = 0 THEN 'likely_operational_ai' WHEN ad OR (strong_h > 0 AND operational_h > 0 AND first_person_h > 0 AND NOT mk) THEN 'possible_operational_ai' WHEN strong_h > 0 OR (broad_h > 0 AND operational_h > 0 AND first_person_h > 0) THEN 'ambiguous_ai_discussion' ELSE 'generic_or_non_operational' END AS label FROM c)"""


@add(f"WITH {_AUDIT} SELECT doc_id, sentence_index, score, label FROM l")
def audit_windows(spark, d):
    return A.audit_windows(table(spark, d, "documents"), "doc_id", "text", _PATTERNS).select("doc_id", "sentence_index", "score", "label")


_LAB = "['likely_operational_ai', 'possible_operational_ai', 'ambiguous_ai_discussion', 'generic_or_non_operational']"


@add(f"""WITH {_AUDIT}, g AS (SELECT doc_id, min(list_position({_LAB}, label)) AS r, count(*) AS n, max(score) AS top, count(*) FILTER (WHERE strong_h > 0) AS sw FROM l GROUP BY doc_id)
    SELECT k.doc_id, coalesce(list_extract({_LAB}, CAST(r AS BIGINT)), 'no_ai_evidence_found') AS label, CAST(coalesce(top, 0) AS INT) AS top_score, coalesce(sw, 0) AS strong_windows, coalesce(n, 0) AS candidates FROM clean k LEFT JOIN g USING (doc_id)""")
def heuristic_audit(spark, d):
    return A.audit_texts(table(spark, d, "documents"), "doc_id", "text", _PATTERNS).select("doc_id", "label", "top_score", "strong_windows", "candidates")


@add()
def audit_windows_full(spark, d):
    """Tested by brute force."""
    return A.audit_windows(table(spark, d, "documents"), "doc_id", "text", A.DEFAULT_PATTERNS).drop("sentence")


@add()
def heuristic_audit_full(spark, d):
    """Tested by brute force."""
    return A.audit_texts(table(spark, d, "documents"), "doc_id", "text", A.DEFAULT_PATTERNS)


def _reason():
    return F.when(F.col("parse_status") != "ok", "llm_parse_failure").when((F.col("ai_score") == 1) & (F.col("keyword_hits") > 5), "zero_score_many_keywords").when(F.col("ai_score") == 2, "low_positive_score")


@add("""WITH r AS (SELECT snippet_id, CASE WHEN parse_status <> 'ok' THEN 'llm_parse_failure' WHEN ai_score = 1 AND keyword_hits > 5 THEN 'zero_score_many_keywords' WHEN ai_score = 2 THEN 'low_positive_score' END AS reason, CASE WHEN keyword_hits > 8 THEN 'likely_operational_ai' WHEN keyword_hits > 2 THEN 'ambiguous_ai_discussion' ELSE 'no_ai_evidence_found' END AS label FROM snippets),
    f AS (SELECT reason, CASE WHEN reason = 'llm_parse_failure' THEN CASE label WHEN 'likely_operational_ai' THEN 'parser_failure_high_risk' ELSE 'parser_failure_probably_harmless' END WHEN reason = 'zero_score_many_keywords' THEN CASE label WHEN 'likely_operational_ai' THEN 'zero_score_false_negative_likely' ELSE 'zero_score_probably_ok' END
    WHEN reason = 'low_positive_score' THEN CASE label WHEN 'no_ai_evidence_found' THEN 'low_positive_false_positive_likely' WHEN 'ambiguous_ai_discussion' THEN 'low_positive_ambiguous' ELSE 'low_positive_probably_ok' END ELSE 'unclassified' END AS issue_flag FROM r) SELECT reason, issue_flag, count(*) AS n FROM f GROUP BY reason, issue_flag""")
def issue_flags(spark, d):
    label = F.when(F.col("keyword_hits") > 8, "likely_operational_ai").when(F.col("keyword_hits") > 2, "ambiguous_ai_discussion").otherwise("no_ai_evidence_found")
    rows = table(spark, d, "snippets").select("snippet_id", _reason().alias("reason"), label.alias("label"))
    return A.flag_counts(A.with_flags(rows, "reason", "label"), "reason", "issue_flag")


@add("""SELECT snippet_id, CASE WHEN coalesce(trim(snippet_text, ' '), '') = '' THEN 'empty_text' WHEN coalesce(keyword_hits, 0) = 0 THEN 'zero_no_keyword' ELSE 'call' END AS decision FROM snippets""")
def prefilter_routing(spark, d):
    return S.route(table(spark, d, "snippets"), "snippet_text", "keyword_hits", "snippet_id").select("snippet_id", "decision")


@add("SELECT snippet_id, CAST(coalesce(length(snippet_text), 0) AS INT) AS text_length, coalesce(max_prompt_chars > 0 AND coalesce(length(snippet_text), 0) >= max_prompt_chars, FALSE) AS at_limit FROM snippets")
def snippet_audit(spark, d):
    return S.snippet_audit(table(spark, d, "snippets"), "snippet_text", "max_prompt_chars").select("snippet_id", "text_length", "at_limit")


_WORD = r"\p{L}\p{M}\p{N}_"
# Digits that stand alone; every separator is doubled first, as two neighbours would share one.
_TOK = rf"list_distinct(regexp_extract_all(regexp_replace(raw_response, '([^{_WORD}])', '\1\1', 'g'), '(?:^|[^{_WORD}])([123])(?:$|[^{_WORD}])', 1))"


@add(f"""SELECT response_id, CASE WHEN coalesce(raw_response, '') = '' THEN 'missing_output' WHEN len({_TOK}) = 0 THEN 'no_score_found' WHEN len({_TOK}) > 1 THEN 'conflicting_scores' ELSE 'ok' END AS parsed_status,
    CASE WHEN coalesce(raw_response, '') <> '' AND len({_TOK}) = 1 THEN CAST({_TOK}[1] AS INT) END AS parsed_score FROM responses""")
def score_parse(spark, d):
    return S.plain_scores(table(spark, d, "responses"), "raw_response").select("response_id", "parsed_status", "parsed_score")


@add()
def score_parse_full(spark, d):
    """With balanced JSON objects; tested on fixtures."""
    return S.parse_scores(table(spark, d, "responses").select("response_id", "raw_response"), "raw_response").select("response_id", "parsed_score", "parsed_status")


@add("""SELECT chunk_id, count(*) AS rows, count(*) FILTER (WHERE parse_status NOT IN ('ok', 'success', 'retry_success')) AS failed, count(*) FILTER (WHERE ai_score = 1) AS score_1, count(*) FILTER (WHERE ai_score = 2) AS score_2, count(*) FILTER (WHERE ai_score = 3) AS score_3,
    round(avg(CASE WHEN ai_score IN (1, 2, 3) THEN ai_score END), 6) AS mean_score, CASE WHEN count(*) FILTER (WHERE parse_status NOT IN ('ok', 'success', 'retry_success')) = 0 THEN 'complete' WHEN count(*) FILTER (WHERE parse_status NOT IN ('ok', 'success', 'retry_success')) < count(*) THEN 'partial' ELSE 'failed' END AS state FROM scored_filings GROUP BY chunk_id""")
def chunk_report(spark, d):
    from panelwright.plans.common import rounded

    return rounded(S.chunk_report(table(spark, d, "scored_filings"), "chunk_id", "parse_status", "ai_score"))


@add("SELECT response_id FROM responses WHERE accession_number IN (SELECT accession_number FROM responses GROUP BY accession_number HAVING count(*) > 1)")
def dup_accession_report(spark, d):
    return S.duplicate_report(table(spark, d, "responses"), "accession_number").select("response_id")


@add(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' ') AS squished, sha256(text) AS digest FROM documents")
def squished_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.squish(F.col("text")).alias("squished"), F.sha2("text", 256).alias("digest"))


def queries():
    return registry.query


def oracle_sql():
    return registry.sql
