"""Evidence on shortened answers and length limits, and refusals and truncations that the patterns weren't written from."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.llm import responses as R

PROMPT = "Please grade the disclosed AI adoption below and explain.\n\nEXTRACT\nWe use speech recognition for claims triage in our northern plants. Sales fell by 5.2 percent in 2019."


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, prompt string, raw string, why string")
    out = R.defects(df, row_id="id", prompt=F.col("prompt"), raw=F.col("raw"), explanation=F.col("why"), **options)
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("ranges", [200_000, 3])
def test_shortened_against_brute_force(spark, ranges):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = [(t, rng.random() < 0.6) for t in texts]
    tails = {t for t, tail in rows if tail}
    got = {r["text"]: r for r in R.shortened(spark.createDataFrame(rows, "text string, tail boolean"), ranges).collect()}
    assert set(got) == tails
    for t in tails:
        assert (got[t]["goes_on"] is not None) == any(u != t and u.startswith(t) for u in texts)
        common = max((len(t) if u.startswith(t) else next((i for i, (a, b) in enumerate(zip(t, u)) if a != b), min(len(t), len(u))) for u in set(texts) if u != t), default=0)
        assert got[t]["common"] == pytest.approx(common / len(t) if common >= R.COMMON_LEAST else 0)


def test_only_what_goes_on_within_the_sentence_counts(spark):
    rows = [("The tool is in use", True), ("The tool is in use.", False), ("The tool is in us", True), ("It rose to 3.", True), ("It rose to 3.5 percent.", False), ("文は続", True), ("文は続。", False), ("文は続く。", False)]
    got = {r["text"]: r["goes_on"] for r in R.shortened(spark.createDataFrame(rows, "text string, tail boolean")).collect()}
    assert got == {"The tool is in use": ".", "The tool is in us": "e", "It rose to 3.": "5 percent.", "文は続": "く。"}
    assert not R.is_truncated("unfinished", ".", 1.0, False) and R.is_truncated("unfinished", "e", 1.0, False) and R.is_truncated("doubtful", "5 percent.", 1.0, False)


WHOLE = ["The filing describes computer vision applied to order picking and says that the tool runs.", "Only a limited pilot for claims triage is mentioned, without a date.", "Management declined to name a launch date for the assistant."]


def test_evidence_decides(spark):
    """Without a longer version, a neighbour or a limit a missing full stop isn't a truncation."""
    rows = [(i, PROMPT, f"Score: 2\n{w}", None) for i, w in enumerate(WHOLE)]
    short = [(10, PROMPT, "Score: 1\nOnly a limited pilot for claims tri", None), (11, PROMPT, "Only a limited pilot for claims triage is mentioned wi", None), (12, PROMPT, "Management declined to name a launch date for the assistant", None), (13, PROMPT, "A forecasting engine is used by all planners", None)]
    assert found(spark, [*rows, *short]) == [(10, "truncated"), (11, "truncated")]
    assert found(spark, short[:1]) == [] and found(spark, rows) == []
    assert found(spark, [*rows, *short], range_rows=2) == [(10, "truncated"), (11, "truncated")]


def test_length_limits(spark):
    lengths = [100] * 60 + list(range(60, 140))
    assert [r[0] for r in R.length_limits(spark.createDataFrame([(n,) for n in lengths], "length int")).collect()] == [100]


def test_limit_decides_doubtful_endings(spark):
    for answer in ("The filing reports revenue of $1.", "Sales rose to 12.", "It was adopted in Sept.", "It is used by Acme Corp."):
        assert R.defect(answer, PROMPT, None, True) == "truncated" and R.defect(answer, PROMPT) is None
    assert R.defect("The tool is in use.", PROMPT, None, True) is None
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    cut_off = [(i, PROMPT, " ".join(word() for _ in range(9))[:50].strip().ljust(50, "x"), None) for i in range(60)]
    rows = [*cut_off, (100, PROMPT, "T".rjust(1) + "he filing tells of tools and of total sales of 31."[:49], None), (101, PROMPT, "Sales rose to 12.", None)]
    assert len(rows[60][2]) == 50
    assert found(spark, rows) == [*((i, "truncated") for i in range(60)), (100, "truncated")]


def test_whole_answers_make_no_limit(spark):
    """Many equal whole answers of one length don't make an answer of that length broken."""
    equal = [(i, PROMPT, "Score 2 was read from the reply (bounded use).", None) for i in range(200)]
    assert found(spark, [*equal, (999, PROMPT, "The company reports total net sales of only 1.", None)]) == []


def test_scripts_without_marks(spark):
    """Where no sentence ends with a mark only the evidence tells."""
    thai = "บริษัทใช้แบบจำลองภาษาในโรงงานทุกแห่งแล้ว"
    assert found(spark, [(1, thai, thai + " รายงานระบุผล", None), (2, thai, thai + " รายงาน", None)])[-1:] == [(2, "truncated")] or R.is_copy(thai, thai)


# Written after the patterns and not used to change them, but for the first two refusals and the first sound answer, which a review had named before.

REFUSED = [
    "Providing a number for this filing is not something the assistant will do.", "This request violates the content policy, so no result is given.", "I am afraid I can't do that; rating companies is off limits for me.", "My apologies, however I will not be grading this disclosure.",
    "As a language model I should not judge issuers of securities.", "No assessment can be provided for this passage.", "I have decided to abstain from rating this extract.", "It is against my rules to classify firms this way.", "I don't believe I should evaluate this text, so please ask an analyst. I am unable to respond.",
    "Sorry, I cannot answer this question.", "Giving a verdict on this filing would be inappropriate, and I must decline.", "I'm not allowed to share an opinion on listed companies.", "The request cannot be fulfilled because it asks me to rate a company.", "I would prefer not to assign a grade here.",
    "We are unable to provide a rating for this text.", "That is outside my scope, so I cannot help with the classification.", "I refuse to perform this task.", "Regrettably the system cannot produce a score for this content.", "I'm going to pass on this one.", "Unfortunately it isn't possible for me to evaluate the extract.",
    "Niestety nie mogę ocenić tego fragmentu.", "Przykro mi, ale nie jestem w stanie podać wyniku.", "К сожалению, я не могу оценить этот отрывок.", "Я вынужден отказаться от оценки этого текста.", "죄송하지만 이 발췌문을 평가해 드릴 수 없습니다.", "이 요청에는 답변할 수 없습니다.",
    "Tyvärr kan jag inte bedöma det här utdraget.", "Jag måste avböja att sätta ett betyg på texten.", "Leider kann ich diesen Auszug nicht bewerten.", "Je regrette, mais je ne suis pas autorisé à noter cet extrait.", "Lo siento, no puedo calificar este texto.", "Non posso valutare questo brano.",
    "Helaas kan ik deze tekst niet beoordelen.", "Não posso avaliar este trecho.", "申し訳ありませんが、採点は行えません。", "抱歉,我无法评价这段文字。", "Valitettavasti en voi arvioida tätä otetta.", "Sajnálom, nem tudom értékelni ezt a szöveget.", "Bu metni değerlendiremem, üzgünüm.", "Jeg kan desværre ikke vurdere dette uddrag.",
]
SOUND = [
    "I cannot determine from the text that AI is in production, so the score is 1.", "The company could not deploy the model in time. A pilot remains.", "Management would not disclose the number of users.", "I could not find any sign of deployment in the passage.", "The board declined to comment on the assistant.",
    "No production use is described, and the passage is about risk.", "The firm says it is unable to measure results.", "I rated this 2 because the pilot does not cover all plants.", "The rules of the exchange prohibit automated trading, which limits the tool.", "I do not see evidence of a rollout. The score is 1.",
    "The assistant answers customer questions in two countries.", "The model cannot classify damaged labels, according to the filing.", "Regulation may prevent the company from using the system.", "The request volume handled by the bot grew by a third.", "The text is outside the usual scope of risk language and names a product.",
    "The passage refuses to commit to a date.", "Score: 1\nThe tool is not in use.", "I chose 3, as the system is used in all stores and not only in a test.", "We weighed the sentence on claims and ignored plans.", "The company opted out of the programme.",
    "Spółka nie może jeszcze podać wyników, ale używa już modelu.", "Ocena wynosi 2, ponieważ pilotaż nie obejmuje wszystkich zakładów.", "Компания не может назвать срок, но модель уже используется.", "Оценка равна 2, потому что система уже работает.", "회사는 이미 이 모델을 모든 공장에서 사용하고 있습니다.",
    "점수는 2점이며 시험 운영만 언급되어 있습니다.", "Företaget kan inte ange något datum men använder redan modellen.", "Betyget är 2 eftersom piloten inte omfattar alla fabriker.", "Das Unternehmen kann keinen Termin nennen, nutzt das Modell aber bereits.", "L'entreprise ne peut pas encore chiffrer les gains, mais l'outil fonctionne.",
    "La empresa no puede dar cifras, pero ya usa el modelo.", "L'impresa non può indicare una data, ma usa già il sistema.", "Het bedrijf kan nog geen cijfers geven, maar gebruikt het model al.", "A empresa não pode indicar uma data, mas já usa o modelo.", "同社は導入時期を示していないが、すでに運用している。",
    "该公司尚不能量化收益,但已在使用该模型。", "Yhtiö ei voi kertoa ajankohtaa, mutta käyttää jo mallia.", "A vállalat nem tud időpontot mondani, de már használja a modellt.", "Şirket henüz tarih veremiyor ama modeli kullanıyor.", "Selskabet kan ikke oplyse en dato, men bruger allerede modellen.",
]


def test_held_out_refusals():
    hits, alarms = sum(map(R.is_refusal, REFUSED)), sum(map(R.is_refusal, SOUND))
    assert hits >= 0.9 * len(REFUSED) and hits >= 0.9 * (hits + alarms)


def test_held_out_truncations(spark):
    """Answers in four languages that no list of endings knows, each cut somewhere, beside whole ones and their like."""
    rng = random.Random(8)
    bases = [
        ("Ocena wynosi dwa, ponieważ spółka {} używa modelu w zakładzie numer {} od roku.", ["już", "tylko", "częściowo"]), ("Оценка равна двум, так как компания {} применяет модель на заводе номер {} с прошлого года.", ["уже", "только", "частично"]),
        ("회사는 {} 공장 {} 곳에서 언어 모델을 매일 사용하고 있습니다.", ["이미", "현재", "일부"]), ("Betyget är två eftersom företaget {} använder modellen i fabrik nummer {} sedan ett år.", ["redan", "bara", "delvis"]),
    ]
    asked = ["Proszę ocenić poniższy fragment raportu i podać krótkie uzasadnienie.", "Оцените следующий отрывок из отчёта и кратко поясните.", "다음 보고서 발췌문을 평가하고 설명해 주세요.", "Bedöm följande utdrag ur en årsredovisning och förklara kort."]
    rows, cut_ids = [], set()
    for i in range(400):
        base, words = bases[i % 4]
        text = base.format(rng.choice(words), rng.randint(1, 12))
        if rng.random() < 0.25:
            text = text[: rng.randint(len(text) // 3, len(text) - 3)].rstrip()
            cut_ids.add(i)
        rows.append((i, asked[i % 4], text, None))
    got = {i for i, defect in found(spark, rows) if defect == "truncated"}
    assert len(got & cut_ids) >= 0.9 * len(cut_ids) and len(got & cut_ids) >= 0.9 * len(got)
