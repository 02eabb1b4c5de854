"""Scoring runs: prompts, records, chunks, repair of failed rows, and gates before outputs are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.contracts import ContractError
from panelwright.operators.recode import year_cap
from panelwright.operators.scoring import Scorer, prompts, require_one_profile, route, score_with_retry, snippet_audit

# The prompts around a piece of evidence.
RUBRIC = """Score 1 - No disclosed current implementation: No concrete current use or specific active implementation. Plans, exploration, risks, general discussion, capacity building, and AI activity by other firms do not count.
Score 2 - Emerging or bounded implementation: A specific AI application is in active development, testing, or pilot, or is in limited production use.
Score 3 - Established and integrated implementation: Current production or operational use is explicit and AI is deployed at meaningful scale or embedded in a core product, service, function, or process.

AI-enabled products or services currently provided by the firm count.

If the evidence is ambiguous, choose the lower score.
"""
TASK = "You are an expert analyst. Using the classification rules below, classify the firm's disclosed AI adoption using only the extracted filing evidence. Do not rely on outside knowledge.\n\n"
ONE_CHARACTER = "Return only one character: 1, 2, or 3.\n\n"
ONE_DIGIT = "Output exactly one ASCII digit—1, 2, or 3—and nothing else. Do not include an explanation, punctuation, markdown, or JSON.\n\n"
EVIDENCE, EVIDENCE_END = "EXTRACTED FILING EVIDENCE:\n<filing_text>\n", "\n</filing_text>\n"
# Defaults of a record before its filing is routed.
RECORD = {
    "keyword_hits": 0, "prefilter_decision": "not_applicable", "snippet_chars": 0, "llm_called": False, "endpoint_attempts": 0, "parse_status": "not_called", "initial_score_status": "", "retry_attempted": False,
    "retry_score_status": "", "ai_score": None, "ai_score_label": None, "score_explanation": "", "score_status": "", "job_id": "", "snippet_sha256": "", "raw_json_sha256": "",
}
_TYPES = {"ai_score": "int", "ai_score_label": "string"}
# States of an extraction that count as done, and states of a score that don't need repair.
DONE = ["extracted", "no_keyword", "skipped_valid"]
SCORED = ["success", "retry_success"]


def with_prompts(df: DataFrame, snippet: str) -> DataFrame:
    """Adds prompt and retry_prompt around the snippet; null without one."""
    before = f"{TASK}{RUBRIC}\n"
    out = prompts(df, snippet, before + ONE_CHARACTER + EVIDENCE, EVIDENCE_END)
    return prompts(out, snippet, before + ONE_DIGIT + EVIDENCE, EVIDENCE_END, "retry_prompt")


def records(df: DataFrame, settings: dict[str, object]) -> DataFrame:
    """df with the run's settings and a record's default columns, where it hasn't got them; keys are trimmed texts."""
    ready = {c: F.lit(v).cast(_TYPES[c]) if c in _TYPES else F.lit(v) for c, v in (settings | RECORD).items() if c not in df.columns}
    return df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("accession_number", "cik", "form_type") if c in df.columns} | ready)


def process_chunk(df: DataFrame, row_id: str, snippet: str, hits: str, make: Callable[[], Scorer], *, settings: dict[str, object] | None = None, last_year: int = 0, mode: str = "hard_zero", limit: int = 0) -> DataFrame:
    """Records of a chunk's filings with decision, score, state and audit of the snippet.

    Rows up to last_year (0: all) get a record, are routed by their hits and, where the decision is a call, scored with one
    retry. Those without a term get the score 1 without a call; empty texts get none. row_id must be unique. Chunks are told
    apart by a column, not by a loop: one plan does all of them.
    """
    rows = route(records(year_cap(df, "year", last_year), settings or {}), snippet, hits, row_id, mode)
    called = F.col("decision").isin("call", "audit_call", "call_without_keyword")
    sent = with_prompts(rows.filter(called), snippet)
    scores = score_with_retry(sent.select(row_id, "prompt", "retry_prompt"), row_id, "prompt", "retry_prompt", make).select(row_id, F.col("score").alias("__score"), F.col("parse_status").alias("__status"), F.col("attempts").alias("__attempts"))
    out = rows.join(scores, row_id, "left")
    zero = F.col("decision") == "zero_no_keyword"
    out = out.withColumns({
        "llm_called": called, "prefilter_decision": F.col("decision"), "snippet_chars": F.coalesce(F.char_length(snippet), F.lit(0)), "endpoint_attempts": F.coalesce("__attempts", F.lit(0)),
        "retry_attempted": F.coalesce(F.col("__attempts") > 1, F.lit(False)), "ai_score": F.when(zero, 1).otherwise(F.col("__score")).cast("int"), "parse_status": F.when(called, F.col("__status")).otherwise(F.lit("not_called")),
    })
    return snippet_audit(out.drop("__score", "__status", "__attempts").withColumn("__limit", F.lit(limit)), snippet, "__limit").drop("__limit")


def chunk_summary(done: DataFrame, chunk: str, score: str = "ai_score", status: str = "parse_status") -> DataFrame:
    """One row per chunk of processed records: decisions, calls, retries, states, scores, lengths and the chunk's own state."""
    c = F.col
    decisions = ("empty_text", "zero_no_keyword", "call", "audit_call", "call_without_keyword")
    states = ("success", "retry_success", "failed", "not_called")
    called = c("llm_called")
    out = done.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cik").alias("firms"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        *(F.count_if(c("decision") == x).alias(f"decision_{x}") for x in decisions), F.count_if(called).alias("called"), F.count_if(c("retry_attempted")).alias("retried"), F.coalesce(F.sum("endpoint_attempts"), F.lit(0)).alias("attempts"),
        *(F.count_if(c(status) == x).alias(f"state_{x}") for x in states), *(F.count_if(c(score) == s).alias(f"score_{s}") for s in (1, 2, 3)), F.count_if(c(score).isNull()).alias("score_missing"), F.avg(score).alias("mean_score"),
        F.avg(F.when(called, c(score))).alias("mean_called_score"), F.sum("keyword_hits").alias("hits"), F.max("keyword_hits").alias("most_hits"), F.sum("snippet_chars").alias("chars"), F.max("snippet_chars").alias("most_chars"), F.count_if(c("at_limit")).alias("at_limit"),
    )
    failed = c("state_failed")
    return out.withColumns({"failure_share": F.try_divide(failed, c("called")), "state": F.when(failed == 0, "complete").when(failed < c("called"), "partial").otherwise("failed")})


def failed_rows(done: DataFrame, called: str = "llm_called", status: str = "parse_status") -> DataFrame:
    """Rows of an earlier output that were sent and came back without a usable score."""
    return done.filter(F.coalesce(F.col(called), F.lit(True)) & ~F.coalesce(F.col(status), F.lit("")).isin(*SCORED))


def repaired(done: DataFrame, row_id: str, snippet: str, make: Callable[[], Scorer], profile: list[str]) -> DataFrame:
    """An earlier output with its failed rows scored again: score and state are replaced where the new try succeeds.

    Fails unless the output was made under one profile. Other rows and columns stay as they are; row_id must be unique.
    """
    done = require_one_profile(done, profile)
    again = with_prompts(failed_rows(done).select(row_id, snippet), snippet)
    new = score_with_retry(again.select(row_id, "prompt", "retry_prompt"), row_id, "prompt", "retry_prompt", make).filter(F.col("parse_status").isin(*SCORED))
    new = new.select(row_id, F.col("score").alias("__score"), F.col("parse_status").alias("__status"))
    out = done.join(new, row_id, "left").withColumn("repaired", F.col("__status").isNotNull())
    return out.withColumns({"ai_score": F.coalesce("__score", F.col("ai_score")), "parse_status": F.coalesce("__status", F.col("parse_status"))}).drop("__score", "__status")


def endpoint_state(first: Column, retry: Column, error: Column) -> Column:
    """State of a row whose call may have ended in an error: an error of the endpoint without any answer stands by itself."""
    return F.when(first == "ok", "success").when(retry == "ok", "retry_success").when(error.isNotNull() & first.isNull(), "endpoint_error").when(error.isNotNull() & retry.isNull(), "retry_endpoint_error").otherwise("failed")


def incomplete(manifest: DataFrame, status: str = "extract_status") -> DataFrame:
    """(status, n): states of filings whose extraction isn't done."""
    return manifest.filter(~F.coalesce(F.col(status), F.lit("")).isin(*DONE)).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def require_complete(manifest: DataFrame, status: str = "extract_status") -> DataFrame:
    """Fails with the states found unless every extraction is done."""
    left = incomplete(manifest, status).orderBy(F.desc("n")).limit(20).collect()
    if left:
        raise ContractError("extraction is incomplete: " + ", ".join(f"{r[0]} {r[1]}" for r in left))
    return manifest


def parity(left: DataFrame, right: DataFrame, chunk: str) -> DataFrame:
    """(chunk, left_rows, right_rows, same) of two copies of an output; a chunk of one of them has -1 in the other."""
    count = lambda df, n: df.groupBy(chunk).agg(F.count(F.lit(1)).alias(n))
    both = count(left, "left_rows").join(count(right, "right_rows"), chunk, "full")
    out = both.na.fill(-1, ["left_rows", "right_rows"])
    return out.withColumn("same", F.col("left_rows") == F.col("right_rows"))
