"""Heuristic audit of texts: scored sentence windows by pattern counts, in columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import spread

#: Names of the patterns that audit_windows takes; values are Java regular expressions, case ignored by (?i).
PATTERNS = ("strong", "broad", "operational", "first_person", "low_value", "adoption", "market")

_AI = (
    r"\b(?:artificial intelligence|machine learning|deep learning|neural networks?|artificial neural networks?|computer vision|natural language processing|natural language understanding|machine translation|"
    r"generative ai|genai|large language models?|foundation models?|transformer models?|conversational ai|virtual assistants?|copilots?|ai assistants?|ai agents?|agentic ai|llms?)\b"
)
_ADOPT = (
    r"\b(?:use|uses|used|using|leverage|leverages|leveraged|leveraging|apply|applies|applied|applying|adopt|adopts|adopted|adopting|deploy|deploys|deployed|deploying|integrate|integrates|integrated|integrating|"
    r"embed|embeds|embedded|embedding|power|powers|powered|powering|enable|enables|enabled|enabling|build|builds|built|building|develop|develops|developed|developing)\b"
)
# The full patterns of the audit of filings.
DEFAULT_PATTERNS = {
    "strong": f"(?iU){_AI}",
    "broad": r"(?iU)\b(?:big data|business intelligence|data science|data scientists?|predictive analytics?|recommendation engines?|expert systems?|data mining|pattern recognition|anomaly detection|decision engines?|fraud detection|recommender systems?)\b",
    "operational": (
        r"(?iU)\b(?:use|uses|used|using|deploy|deploys|deployed|deployment|implemented|implements|integrated|integrates|integration|embedded|operates|operational|automate|automates|automated|recommend|recommends|detect|detects|"
        r"forecast|forecasts|predict|predicts|optimize|optimizes|personalize|personalizes|supports?|provides?|offers?|delivers?|powers?|enables?|allowing|facilitates?|built|builds|based on)\b"
    ),
    "first_person": r"(?iU)\b(?:we|our|company|business|businesses|firm|products?|services?|platforms?|systems?|tools?|applications?|solution|solutions)\b",
    "low_value": (
        r"(?iU)\b(?:risk|risks|could|may|might|intend|intends|plan|plans|future|potential|regulation|regulatory|competition|competitors|cybersecurity|pilot|pilots|proof of concept|experiment|experiments|research|market|industry|"
        r"demand|opportunity|opportunities|expect|expects|expected|forecast|litigation|lawsuit|alleging|unauthorized|copied|copying)\b"
    ),
    "adoption": f"(?iU)(?:{_ADOPT}.{{0,80}}{_AI}|{_AI}.{{0,80}}{_ADOPT}|" + r"\b(?:ai-powered|ai/ml-powered|machine learning-powered|powered by artificial intelligence|powered by machine learning)\b)",
    "market": (
        r"(?iU)\b(?:applications? for|applications? in|targeting|targeted|target|markets? for|market|industry|customers?|opportunity|opportunities|growth markets?|focus on|focused on|invest in|investing in|"
        r"litigation|lawsuit|regulation|regulatory|competition|driving demand|trend|trends)\b"
    ),
}


def sentences_of(text: str, split: str = r"(?<=[.!?;])\s+") -> Column:
    """The sentences of a text with white space collapsed, blank ones left out."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(clean, split), F.trim), lambda x: x != "")


def sentence_rows(df: DataFrame, key: str, text: str, split: str = r"(?<=[.!?;])\s+") -> DataFrame:
    """(key, sentence_index, sentence)."""
    return df.select(key, F.posexplode(sentences_of(text, split)).alias("sentence_index", "sentence"))


def audit_windows(df: DataFrame, key: str, text: str, patterns: dict[str, str], split: str = r"(?<=[.!?;])\s+") -> DataFrame:
    """Candidate sentences (strong or broad pattern) with their neighbours as window, hit counts, score and label.

    Neighbours are taken from the text's array of sentences before it becomes rows, so nothing is shuffled.
    """
    texts = spread(df.select(key, text)).select(key, sentences_of(text, split).alias("__s"))
    # Each sentence between its neighbours: the same array moved by one either way, zipped.
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("__s"))
    after = F.slice("__s", F.lit(2), F.greatest(F.size("__s") - 1, F.lit(0)))
    rows = texts.select(key, F.posexplode(F.arrays_zip(before.alias("before"), F.col("__s").alias("sentence"), after.alias("after"))).alias("sentence_index", "__z"))
    rows = rows.select(key, "sentence_index", F.col("__z.sentence").alias("sentence"), F.col("__z.before").alias("__b"), F.col("__z.after").alias("__a"))
    rows = rows.filter(F.col("sentence").rlike(patterns["strong"]) | F.col("sentence").rlike(patterns["broad"]))
    rows = rows.select(key, "sentence_index", "sentence", F.concat_ws(" ", "__b", "sentence", "__a").alias("window"))
    rows = rows.withColumns({f"{p}_hits": F.regexp_count("window", F.lit(patterns[p])) for p in ("strong", "broad", "operational", "first_person", "low_value")})
    rows = rows.withColumns({"adoption": F.col("window").rlike(patterns["adoption"]), "market": F.col("window").rlike(patterns["market"])})
    has = {p: F.col(f"{p}_hits") > 0 for p in ("strong", "broad", "operational", "first_person", "low_value")}
    points = ((has["strong"], 4), (has["broad"], 1), (has["operational"], 2), (has["first_person"], 1), (F.col("adoption"), 3), (F.col("market"), -1))
    score = sum((F.when(c, n).otherwise(0) for c, n in points), -F.least(F.col("low_value_hits"), F.lit(2)))
    acting = has["operational"] & has["first_person"]
    label = (
        F.when(F.col("adoption") & has["first_person"] & ~has["low_value"], "likely_operational_ai")
        .when(F.col("adoption") | (has["strong"] & acting & ~F.col("market")), "possible_operational_ai")
        .when(has["strong"] | (has["broad"] & acting), "ambiguous_ai_discussion").otherwise("generic_or_non_operational")
    )
    return rows.withColumns({"score": score.cast("int"), "label": label})


# Labels from best to worst; the last stands for a text without a candidate.
LABELS = ["likely_operational_ai", "possible_operational_ai", "ambiguous_ai_discussion", "generic_or_non_operational", "no_ai_evidence_found"]


def audit_texts(df: DataFrame, key: str, text: str, patterns: dict[str, str], split: str = r"(?<=[.!?;])\s+") -> DataFrame:
    """Per text the best label, the window and score of its best candidate (the first of equals), and counts."""
    rows = audit_windows(df, key, text, patterns, split)
    rank = F.coalesce(*(F.when(F.col("label") == x, i) for i, x in enumerate(LABELS)))
    top = F.min(F.struct((-F.col("score")).alias("s"), "sentence_index", "window"))
    agg = rows.groupBy(key).agg(F.min(rank).alias("__r"), top.alias("__t"), F.count_if(F.col("strong_hits") > 0).alias("strong_windows"), F.count_if(F.col("broad_hits") > 0).alias("broad_windows"), F.count_if(F.col("operational_hits") > 0).alias("operational_windows"), F.count(F.lit(1)).alias("candidates"))
    out = df.select(key).distinct().join(agg, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    names = F.array(*(F.lit(x) for x in LABELS))
    return out.select(key, F.get(names, F.coalesce("__r", F.lit(len(LABELS) - 1))).alias("label"), F.coalesce("__t.window", F.lit("")).alias("top_evidence"), (-F.coalesce("__t.s", F.lit(0))).alias("top_score"), zero("strong_windows"), zero("broad_windows"), zero("operational_windows"), zero("candidates"))


# Reason, label and flag; an empty label stands for all others.
FLAGS = [
    ("llm_parse_failure", "likely_operational_ai", "parser_failure_high_risk"), ("llm_parse_failure", "possible_operational_ai", "parser_failure_medium_risk"), ("llm_parse_failure", "", "parser_failure_probably_harmless"),
    ("zero_score_many_keywords", "likely_operational_ai", "zero_score_false_negative_likely"), ("zero_score_many_keywords", "possible_operational_ai", "zero_score_false_negative_likely"), ("zero_score_many_keywords", "", "zero_score_probably_ok"),
    ("low_positive_score", "generic_or_non_operational", "low_positive_false_positive_likely"), ("low_positive_score", "no_ai_evidence_found", "low_positive_false_positive_likely"),
    ("low_positive_score", "ambiguous_ai_discussion", "low_positive_ambiguous"), ("low_positive_score", "", "low_positive_probably_ok"),
    ("switch_off_after_positive", "likely_operational_ai", "switch_off_false_negative_likely"), ("switch_off_after_positive", "possible_operational_ai", "switch_off_maybe_false_negative"), ("switch_off_after_positive", "", "switch_off_rule_noisy_or_ok"),
]


def with_flags(df: DataFrame, reason: str, label: str, flag: str = "issue_flag") -> DataFrame:
    """Adds the flag of the reason and label; ``unclassified`` for an unknown or null reason."""
    out = F.lit("unclassified")
    for r, x, f in reversed(FLAGS):
        hit = (F.col(reason) == r) & ((F.col(label) == x) if x else F.lit(True))
        out = F.when(hit, f).otherwise(out)
    return df.withColumn(flag, out)


def flag_counts(df: DataFrame, reason: str, other: str) -> DataFrame:
    return df.groupBy(reason, other).agg(F.count(F.lit(1)).alias("n"))
