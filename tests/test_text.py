"""Text operators on literals."""

import re

import pytest
from pyspark.sql import functions as F

from panelwright.operators import audit as A
from panelwright.operators import evidence as E
from panelwright.operators import scoring as S
from panelwright.operators import text as W
from panelwright.operators.lexicon import DEFAULT_TERMS, Scanner, Term

M = Scanner(DEFAULT_TERMS)


def names(text):
    return [m.term.name for m in M.route(text)]


@pytest.mark.parametrize("text", ["We use AI.", "ML and NLP.", "A.I. systems", "XGBoost and Keras", "We integrated Claude into our chatbot", "Microsoft Copilot is used"])
def test_routed(text):
    assert names(text)


@pytest.mark.parametrize("text", ["5 mL of mg/ml", "html", "Machinery Leasing (ML)", "a remote learning model", "an electrical transformer", "Claude Bernard", "AI = American Indians", "aircraft copilots", "analytics", ""])
def test_not_routed(text):
    assert not names(text)


def test_all_terms_takes_the_longest():
    assert [m.term.name for m in M.retrieve("generative artificial intelligence and a learning model")] == ["generative_artificial_intelligence", "learning_model"]


def test_html():
    page = "<html><head><title>t</title><style>x</style></head><body><p>One<br>two</p><div style='display: none'>no</div><ix:header>no</ix:header><table><tr><td>a</td><td>b</td></tr></table><span hidden>no</span>&amp;&nbsp;z</body></html>"
    text = W.document_text(page)
    assert "One\ntwo" in text and "no" not in text.split() and "a b" in text and "& z" in text
    assert W.document_text("plain &lt;b&gt;  text") == "plain <b> text"
    assert W.document_text(None) == "" and W.document_text(b"caf\xe9") == "café"


def test_submission_body():
    text = "<DOCUMENT><TYPE>EX-1\n<TEXT>no</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K\n<TEXT>yes</TEXT></DOCUMENT>"
    assert W.submission_body(text, "10-k") == "yes" and W.submission_body(text, "10-Q") is None


def test_windows_merge_and_count():
    text = " ".join(f"Sentence {i} has {'AI' if i in (2, 4, 8) else 'nothing'}." for i in range(1, 10))
    got = W.windows(text, M.retrieve, 1)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 0, 4, 2), (2, 6, 8, 1)]


def test_equal_windows_are_one():
    got = W.windows("We use AI. Other words. We use AI.", M.retrieve, 0)
    assert [(r[0], r[3], r[8]) for r in got] == [(1, 2, 2)]


def test_windows_of_nothing():
    assert W.windows("", M.retrieve, 1) == [] and W.windows("no hit", M.retrieve, 1) == []


FILINGS = [
    "Nothing here. We rely on Machine Learning daily. It works! The lease ends. Costs fell. Artificial Intelligence and LLMs are named; GPT-4 too.",
    "No term at all. Only leases.", "", None, "speech recognition. a limited pilot. risk.", "Our chatbot uses large-language models. More.\nText with ML. End.",
    "Our platform uses deep learning. It is in production.", "Big data supports our services. The market grows.", "AI-powered tools are a risk. Could be. May be. Market demand for neural networks.", "Fraud detection. é. Data mining is a trend.", "Copilots may help us, and we build tools with natural language understanding.",
]


@pytest.fixture
def filings(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(FILINGS)), "doc_id int, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_full_lexicon_queries(spark, filings):
    from panelwright.plans.registry import queries

    rows = lambda name: [r.asDict() for r in queries()[name](spark, filings).collect()]
    want: dict = {}
    for i, text in enumerate(FILINGS):
        low = {(m.start(), m.end()): m.group() for t in DEFAULT_TERMS for m in re.finditer(t.pattern, text or "", 0 if t.exact_case else re.I)}
        kept = [s for s in low if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in low)]
        for s in kept:
            want[i, low[s]] = want.get((i, low[s]), 0) + 1
    hits: dict = {}
    for r in rows("lexicon_hits_full"):
        hits[r["doc_id"], r["matched"]] = hits.get((r["doc_id"], r["matched"]), 0) + r["n"]
    assert hits == want and (0, "Machine Learning") in want and (0, "GPT-4") in want
    per_doc = {i: sum(n for (d, _), n in want.items() if d == i) for i in range(len(FILINGS))}
    windows = rows("keyword_windows_full")
    assert {i: sum(r["keyword_hit_count"] for r in windows if r["doc_id"] == i) for i in per_doc} == per_doc
    counts = {r["doc_id"]: r["windows"] for r in rows("no_hit_sentinels_full")}
    assert {i for i, n in counts.items() if n} == {i for i, n in per_doc.items() if n} and len(counts) == len(FILINGS)
    joined = {r["doc_id"]: r["combined_text"] for r in rows("windows_to_filing_full")}
    assert set(joined) == {i for i, n in per_doc.items() if n} and "GPT-4 too." in joined[0]


def test_full_audit_queries(spark, filings):
    from panelwright.plans.registry import queries

    patterns = {k: re.compile(v.replace("(?iU)", ""), re.I) for k, v in A.DEFAULT_PATTERNS.items()}
    want = {}
    for i, text in enumerate(FILINGS):
        parts = [p for p in re.split(r"(?<=[.!?;])\s+", " ".join((text or "").split())) if p]
        for k, part in enumerate(parts):
            if patterns["strong"].search(part) or patterns["broad"].search(part):
                window = " ".join(parts[max(0, k - 1) : k + 2])
                n = {x: len(p.findall(window)) for x, p in patterns.items()}
                score = 4 * bool(n["strong"]) + bool(n["broad"]) + 2 * bool(n["operational"]) + bool(n["first_person"]) + 3 * bool(n["adoption"]) - bool(n["market"]) - min(n["low_value"], 2)
                acting = n["operational"] and n["first_person"]
                if n["adoption"] and n["first_person"] and not n["low_value"]:
                    label = A.LABELS[0]
                elif n["adoption"] or (n["strong"] and acting and not n["market"]):
                    label = A.LABELS[1]
                else:
                    label = A.LABELS[2] if n["strong"] or (n["broad"] and acting) else A.LABELS[3]
                want[i, k] = (score, label)
    got = {(r["doc_id"], r["sentence_index"]): (r["score"], r["label"]) for r in queries()["audit_windows_full"](spark, filings).collect()}
    assert got == want and {label for _, label in want.values()} == set(A.LABELS[:4])
    best = {r["doc_id"]: (r["label"], r["top_score"], r["candidates"]) for r in queries()["heuristic_audit_full"](spark, filings).collect()}
    for i in range(len(FILINGS)):
        own = [v for (d, _), v in want.items() if d == i]
        assert best[i] == (min((x for _, x in own), key=A.LABELS.index, default=A.LABELS[4]), max((x for x, _ in own), default=0), len(own))


def test_segments_are_bounded():
    text = "word " * 2000 + "and speech recognition " + "more " * 300
    parts = E.segments(text, M)
    assert max(map(len, parts)) <= 900 and any("speech recognition" in p for p in parts)
    assert " ".join(parts).split() == text.split()


def anchors_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("position", F.lit("clash"))
    return E.anchors(df, ["id"], "text", DEFAULT_TERMS).collect()


def snippets_of(spark, texts, budget, reach=1, terms=DEFAULT_TERMS):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["snippet"] for r in E.snippets(df, ["id"], "text", terms, budget, reach).orderBy("id").collect()]


def test_ranking_prefers_current_use(spark):
    use, plan = sorted(anchors_of(spark, "We currently use AI in production across our operations.\nWe plan to explore artificial intelligence in the future."), key=lambda r: r["rank"])
    assert use["quality_band"] == 5 and (use["rank"], plan["rank"]) == (1, 2) and plan["negation_or_future_score"] < 0


# Text, quality band, operational, current use and negative score, total.
SCORED = [
    ("We use machine learning in our products.", 5, 6, 3, 0, 99),
    ("Competitors use AI.", 2, 6, 0, -3, 73),
    ("The system was deployed with deep learning.", 4, 6, 3, 0, 99),
    ("Demand for AI grows.", 2, 0, 0, -2, 68),
    ("We do not use neural networks.", 2, 6, 0, -6, 90),
    ("Predictive models are a potential risk.", 1, 0, 0, -9, 21),
    ("A kernel method is named.", 0, 0, 0, 0, 50),
]


@pytest.mark.parametrize("text,band,near,use,against,total", SCORED)
def test_scores(spark, text, band, near, use, against, total):
    (r,) = anchors_of(spark, text)
    assert (r["quality_band"], r["operational_score"], r["current_use_score"], r["negation_or_future_score"], r["total_score"]) == (band, near, use, against, total)


def test_anchors_of_nothing(spark):
    assert anchors_of(spark, "", None, "No term at all.") == []
    assert E.anchors(spark.createDataFrame([], "id int, text string"), ["id"], "text", DEFAULT_TERMS).count() == 0


def test_near_duplicates_and_budget(spark):
    a = "We use machine learning models to detect fraud in all payment flows of our platform."
    b = "Table of Contents " + a.replace("use", "used")
    assert E.alike(a, b) and not E.alike(a, "Something else entirely is written here about leases and other matters.")
    text = "\n".join([a, b, *("Risk factors about the market and machine learning number %d may apply." % i for i in range(40))])
    for budget in (60, 180, 300, 1000):
        got = snippets_of(spark, [text], budget)[0]
        assert 0 < len(got) <= budget
    assert snippets_of(spark, [text, None, " x "], 0) == [text, "", "x"] and snippets_of(spark, ["short", "", None], 100) == ["short", "", ""]
    with pytest.raises(ValueError):
        snippets_of(spark, ["x"], -1)


def test_context_comes_before_and_after(spark):
    lines = ["The first line is about leases.", "The second line tells of costs.", "We use machine learning here.", "The fourth line is about taxes.", "The last line ends."]
    assert snippets_of(spark, ["\n".join(lines)], 110) == ["\n\n".join(lines[1:4])] and snippets_of(spark, ["\n".join(lines)], 110, 0) == [lines[2]]


@pytest.mark.parametrize("focus", ["head", "tail", (150, 158), (0, 5), (390, 399)])
def test_clip(focus):
    text = "".join(f"word{i} " for i in range(60)).strip()
    for limit in (0, 3, 20, 100, 399, 1000):
        got = E.clip(text, limit, focus)
        assert len(got) <= limit and (limit < len(text) or got == text)
    assert E.clip(text, 62, "head").startswith("word0 ") and E.clip(text, 64, "head").endswith(" ...") and E.clip(text, 60, "tail").endswith("word59") and text[150:158] in E.clip(text, 60, (150, 158))


def test_scanner_against_all_patterns():
    """The automaton finds what searching with every pattern finds, also folded letters and terms without a literal opening."""
    texts = ["ſpeech recognition and ARTİFİCİAL INTELLIGENCE", "AI/ML, (ML), A.I., LLMs; GPT-4.5 and ChatGPT", "deep-learning deep learning", "", "xAI AI-1 AI"]
    terms = [*DEFAULT_TERMS, Term("digits", r"[0-9]+", "plain", 5, 5)]
    for text in texts:
        want = {(m.start(), m.end(), i) for i, t in enumerate(terms) for m in re.finditer(t.pattern, text, 0 if t.exact_case else re.I)}
        assert set(Scanner(terms)._found(text)) == want


def test_sampled_without_a_term(spark):
    text = "\n".join(f"Line {i} of a long filing about nothing in particular, with automation here." if i == 5 else f"Line number {i} is about leases {i} and other item {i}." for i in range(100))
    (got,) = snippets_of(spark, [text], 300)
    assert "Line number 0" in got and "Line 5" in got and len(got) <= 300


@pytest.mark.parametrize("answer,want", [("2", (2, "ok")), ('{"score": 3}', (3, "ok")), ("2 or 3", (None, "conflicting_scores")), ("", (None, "missing_output")), (None, (None, "missing_output")), ("none", (None, "no_score_found")), ("評価は3です", (None, "no_score_found")), ('{"score": "2", "note": "a } b"}', (2, "ok"))])
def test_parse_score(answer, want):
    assert S.parse_score(answer) == want


def test_answer_text_and_options():
    assert S.answer_text({"choices": [{"message": {"content": "2"}}]}) == "2" and S.answer_text([]) == "[]" and S.answer_text(None) == ""
    assert S.generation_options(lambda prompt, temperature, max_tokens: 0, 0.0, 5) == {"temperature": 0.0, "max_tokens": 5}
    assert "config" in S.generation_options(lambda prompt, config: 0, 0.0, 5)
    with pytest.raises(TypeError):
        S.generation_options(lambda prompt: 0, 0.0, 5)


def test_scorer_with_retry(spark):
    def make():
        return lambda pairs: [(k, "unclear" if p == "first" and k != "1" else "2") for k, p in pairs if k != "3"]

    df = spark.createDataFrame([(str(i), "first", "second") for i in (1, 2, 3)], "id string, p string, q string")
    got = {r["id"]: tuple(r)[1:] for r in S.score_with_retry(df, "id", "p", "q", make).collect()}
    assert got == {"1": (2, "success", 1), "2": (2, "retry_success", 2), "3": (None, "failed", 2)}


def test_routing(spark):
    df = spark.createDataFrame([(1, "", 0), (2, "x", 0), (3, "x", 2), (4, None, None)], "id int, t string, h int")
    got = {r["id"]: r["decision"] for r in S.route(df, "t", "h", "id").collect()}
    assert got == {1: "empty_text", 2: "zero_no_keyword", 3: "call", 4: "empty_text"}
    many = spark.range(100).selectExpr("id", "'x' as t", "0 as h")
    audit = S.route(many, "t", "h", "id", mode="audit", rate=0.5, cap=10).groupBy("decision").count().collect()
    assert {r["decision"]: r["count"] for r in audit} == {"audit_call": 10, "zero_no_keyword": 90}
