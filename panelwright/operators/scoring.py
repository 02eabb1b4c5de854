"""Around a scorer: routing, prompts, parsing of answers, retry, and checks on merged outputs.

The scorer itself is any callable that takes (id, prompt) pairs and yields (id, answer) pairs.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.exprs import hash_fraction
from panelwright.operators.contracts import ContractError, duplicate_keys

RETRYABLE = ["missing_output", "no_score_found", "invalid_score", "conflicting_scores"]
# Fields of a JSON answer that can hold the score.
SCORE_FIELDS = ["ai_score", "score", "ai_adoption_score", "ai_level_code", "ai_adoption_level_code"]


def route(df: DataFrame, text: str, hits: str, row_id: str, mode: str = "hard_zero", rate: float = 0.0, cap: int | None = None, chunk: str | None = None, seed: str = "audit") -> DataFrame:
    """Adds decision: ``empty_text``, ``zero_no_keyword``, ``audit_call``, ``call`` or ``call_without_keyword``.

    Of the texts without a term the share rate, by a hash of seed and id, is called for audit in mode audit, per chunk at
    most cap of them in order of id. Mode off calls every text that isn't empty.
    """
    none = F.coalesce(hits, F.lit(0)) == 0
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    sampled = none & ~blank & F.lit(mode == "audit") & (hash_fraction(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string"))) < rate)
    out = df.withColumn("__s", sampled)
    if cap is not None:
        keys = [F.col("__s"), *([F.col(chunk)] if chunk else [F.lit(1)])]
        out = out.withColumn("__s", F.col("__s") & (F.row_number().over(Window.partitionBy(*keys).orderBy(row_id)) <= cap))
    decision = F.when(blank, "empty_text").when(F.col("__s"), "audit_call").when(none & F.lit(mode in ("hard_zero", "audit")), "zero_no_keyword").when(none, "call_without_keyword").otherwise("call")
    return out.withColumn("decision", decision).drop("__s")


def prompts(df: DataFrame, snippet: str, before: str, after: str, name: str = "prompt") -> DataFrame:
    """Adds the snippet between two fixed texts; null where there is none."""
    return df.withColumn(name, F.when(F.trim(snippet) != "", F.concat(F.lit(before), F.col(snippet), F.lit(after))))


def objects(text: str) -> list[str]:
    """Balanced {...} parts of a text, outermost ones, quoted braces ignored."""
    found, i = [], 0
    while (i := text.find("{", i)) >= 0:
        depth, quoted, at = 0, False, i
        while at < len(text):
            c = text[at]
            if quoted:
                if c == "\\":
                    at += 1
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
            at += 1
        if at < len(text):
            found.append(text[i : at + 1])
            i = at + 1
        else:
            i += 1
    return found


def _digit(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    text = str(value).strip()
    return int(text) if text in ("1", "2", "3") else None


def parse_score(answer: str | None) -> tuple[int | None, str]:
    """Score and status of an answer: the digit alone, a field of a JSON object, or digits 1 to 3 standing alone.

    Two different scores are conflicting; an empty answer is missing.
    """
    if not answer:
        return None, "missing_output"
    scores = {int(x) for x in re.findall(r"\b([123])\b", answer)}
    for part in objects(answer):
        try:
            parsed = json.loads(part)
        except ValueError:
            continue
        if isinstance(parsed, dict):
            values = [s for f in SCORE_FIELDS if (s := _digit(parsed.get(f))) is not None]
            scores |= set(values[:1])
    if not scores:
        return None, "no_score_found"
    return (scores.pop(), "ok") if len(scores) == 1 else (None, "conflicting_scores")


def answer_text(response) -> str:
    """The text of a response in any of the usual nested shapes; other objects as JSON."""
    if response is None or isinstance(response, str):
        return response or ""
    if isinstance(response, list):
        return next((t for x in response if (t := answer_text(x))), "") or json.dumps(response, ensure_ascii=False)
    if isinstance(response, dict):
        names = ("generated_text", "text", "output", "response", "completion", "content", "choices", "message", "outputs")
        return next((t for n in names if response.get(n) is not None and (t := answer_text(response[n]))), "") or json.dumps(response, ensure_ascii=False)
    return str(response)


def parse_scores(df: DataFrame, answer: str, score: str = "parsed_score", status: str = "parsed_status") -> DataFrame:
    """Adds score and status of each answer, in Arrow batches."""
    out = T.StructType([*df.schema.fields, T.StructField(score, T.IntegerType()), T.StructField(status, T.StringType())])
    at = df.columns.index(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_score(a) for a in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], out.names)

    return df.mapInArrow(run, out)


def plain_scores(df: DataFrame, answer: str, score: str = "parsed_score", status: str = "parsed_status") -> DataFrame:
    """The same in columns alone, for answers whose JSON scores are digits that stand alone."""
    tokens = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?<![\p{L}\p{M}\p{N}_])([123])(?![\p{L}\p{M}\p{N}_])"), 1))
    blank = F.coalesce(F.col(answer), F.lit("")) == ""
    state = F.when(blank, "missing_output").when(F.size(tokens) == 0, "no_score_found").when(F.size(tokens) > 1, "conflicting_scores").otherwise("ok")
    return df.withColumn(status, state).withColumn(score, F.when(F.col(status) == "ok", tokens[0].cast("int")))


def final_state(df: DataFrame, first: str, retry: str) -> DataFrame:
    """Adds parse_status and attempts from the states of the first answer and of the retry (null if there was none)."""
    retried = F.col(first).isin(*RETRYABLE) & F.col(retry).isNotNull()
    state = F.when(F.col(first) == "ok", "success").when(retried & (F.col(retry) == "ok"), "retry_success").otherwise("failed")
    return df.withColumn("parse_status", state).withColumn("attempts", F.when(retried, 2).otherwise(1))


Scorer = Callable[[Iterable[tuple[str, str]]], Iterable[tuple[str, str]]]


def score_column(df: DataFrame, row_id: str, prompt: str, make: Callable[[], Scorer], answer: str = "answer") -> DataFrame:
    """(row_id, answer) from the scorer that make builds on each worker; answers are matched by id, a lost one is null.

    Rows with a null prompt aren't sent.
    """
    out = T.StructType([df.schema[row_id], T.StructField(answer, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            keys = [str(k) for k in batch.column(0).to_pylist()]
            got = dict(scorer(list(zip(keys, batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([got.get(k) for k in keys], pa.string())], out.names)

    return df.filter(F.col(prompt).isNotNull()).select(row_id, prompt).mapInArrow(run, out)


def score_with_retry(df: DataFrame, row_id: str, prompt: str, retry_prompt: str, make: Callable[[], Scorer]) -> DataFrame:
    """(row_id, score, parse_status, attempts): one retry of the answers without a usable score.

    The first pass is written to the shared folder, so that no prompt is sent twice.
    """
    from panelwright.session import cut

    first = cut(parse_scores(score_column(df, row_id, prompt, make), "answer", "s1", "first"), "scores")
    again = df.join(first.filter(F.col("first").isin(*RETRYABLE)).select(row_id), row_id, "left_semi")
    second = cut(parse_scores(score_column(again, row_id, retry_prompt, make), "answer", "s2", "second"), "retries")
    both = final_state(first.drop("answer").join(second.drop("answer"), row_id, "left"), "first", "second")
    return both.select(row_id, F.coalesce("s1", F.when(F.col("parse_status") == "retry_success", F.col("s2"))).alias("score"), "parse_status", "attempts")


def generation_options(call: Callable, temperature: float, tokens: int) -> dict:
    """The keyword with which a client takes its generation settings; TypeError if it takes none, before any call."""
    names = inspect.signature(call).parameters
    if "temperature" in names and "max_tokens" in names:
        return {"temperature": temperature, "max_tokens": tokens}
    if "config" in names:
        return {"config": {"temperature": temperature, "max_tokens": tokens}}
    if "max_tokens" in names:
        return {"max_tokens": tokens}
    raise TypeError("the client takes no generation settings")


def snippet_audit(df: DataFrame, text: str, limit: str) -> DataFrame:
    """Adds the snippet's length and whether it has reached its limit (0 is none)."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    return df.withColumn("text_length", n).withColumn("at_limit", F.coalesce((F.col(limit) > 0) & (n >= F.col(limit)), F.lit(False)))


def require_one_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails if the merged outputs were made with more than one value of a setting."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    mixed = [c for c in columns if row[c] > 1]
    if mixed:
        raise ContractError(f"outputs of different {', '.join(mixed)}")
    return df


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once."""
    return df.join(duplicate_keys(df, [key]).select(key), key, "left_semi")


def chunk_report(df: DataFrame, chunk: str, status: str, score: str) -> DataFrame:
    """Per chunk its rows, calls that failed, the histogram and mean of scores, and a state: complete, partial or failed."""
    failed = F.count_if(~F.col(status).isin("ok", "success", "retry_success"))
    out = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("rows"), failed.alias("failed"), *(F.count_if(F.col(score) == s).alias(f"score_{s}") for s in (1, 2, 3)), F.avg(F.when(F.col(score).isin(1, 2, 3), F.col(score))).alias("mean_score"))
    return out.withColumn("state", F.when(F.col("failed") == 0, "complete").when(F.col("failed") < F.col("rows"), "partial").otherwise("failed"))
