"""Survivors, pieces, defects, mixes and languages on small tables."""

import random
import re

import pytest
from helpers import DATA, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm import language as L
from panelwright.llm import mixing as X
from panelwright.llm import queries
from panelwright.llm import responses as R
from panelwright.llm import split as S
from panelwright.llm.survivors import best_fields, best_record

SF = DATA / "sf0.001"


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, str(SF)), SF, queries.oracle_sql()[name])


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, str(SF)).count() >= 0


# Survivors

RECORDS = "k string, form string, score int, trust int, at int, rid int, __f0 string"


def survivors(spark, rows, **options):
    df = spark.createDataFrame(rows, RECORDS)
    out = best_fields(df, {"k": F.col("k")}, usable={"form": F.col("form"), "score": F.when(F.col("score") > 0, F.col("score"))}, trust=F.col("trust"), recency=F.col("at"), tie=F.col("rid"), **options)
    return sorted(map(tuple, out.collect()), key=repr)


def test_fields_come_from_different_records(spark):
    rows = [("a", None, 3, 1, 1, 1, "x"), ("a", "10-K", -1, 2, 1, 2, None), ("a", "10-K/A", 2, 2, None, 3, None), ("b", "10-K", 1, 1, 1, 4, None), ("c", None, None, None, None, 5, None), ("c", None, None, None, None, 5, None), (None, "10-K", 1, 1, 1, 6, None), (None, "10-K", 1, 1, 1, 7, None)]
    assert survivors(spark, rows) == [("a", "10-K", 3), ("c", None, None)]
    assert survivors(spark, []) == []


def test_ties(spark):
    rows = [("a", "x", 1, None, 5, 1, None), ("a", "y", 2, 3, None, 2, None), ("a", "z", 3, 3, 5, 3, None), ("a", "w", 4, 3, 5, 4, None)]
    assert survivors(spark, rows) == [("a", "w", 4)]


def test_best_record(spark):
    rows = [("a", None, 3, 1, 1, 1, "x"), ("a", "10-K", 2, 9, 1, 2, None), ("a", "10-K", 2, 9, 1, 3, None), (None, "x", 1, 1, 1, 4, None)]
    out = best_record(spark.createDataFrame(rows, RECORDS), ["k"], usable={"form": F.col("form"), "score": F.col("score")}, trust=F.col("trust"), recency=F.col("at"), tie=F.col("rid"))
    assert [r["rid"] for r in out.collect()] == [3]


# Pieces


def boundary(text, limit):
    breaks = "\n\r\x0b\x0c\x85  "
    for name, marks in (("sentence", ".!?;"), ("clause", ".!?;,|:")):
        parts = re.split(rf"(?<=[{re.escape(marks)}])\s+|\s*[{breaks}]\s*", text)
        if all(len(p.strip()) <= limit for p in parts):
            return name
    return "space" if all(len(p) <= limit for p in text.split()) else "none"


def check(text, limit, overlap):
    pieces, name = S.split_text(text, limit, overlap)
    assert name == boundary(text, limit)
    at, before = 0, None
    for start, begin, end in pieces:
        assert 0 < end - start <= limit and start <= begin
        assert not text[at:begin].strip() and begin >= at
        if start < begin:
            assert before - start <= overlap and start >= 0
        at = before = end
    assert not text[at:].strip()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab .,;:|\n\xa0é漢 ", max_size=200), st.integers(1, 40), st.integers(0, 12))
def test_pieces(text, limit, overlap):
    check(text, limit, overlap)


def test_long_texts():
    check("x y. " * 100_000, 900, 90)
    check("x" * 300_000, 900, 90)
    check(" " * 5000, 900, 90)
    rng = random.Random(1)
    check(" ".join("w" * rng.randint(1, 30) + rng.choice(["", ".", ",", "\n"]) for _ in range(20_000)), 400, 50)


def test_split_items(spark):
    rows = [(1, "a. " * 400, 900), (2, "short", 900), (3, None, 900), (4, "b" * 950, 900), (5, "c" * 5000, 0), (6, " " * 1000, 900), (7, "d" * 20, None), (1, "a. " * 400, 900)]
    df = spark.createDataFrame(rows, "id long, text string, limit int")
    out = S.split_items(df, kind=F.lit("k"), item_id=F.col("id"), text=F.col("text"), limit=F.col("limit"), overlap=90)
    first = sorted((r["item_id"], r["boundary"]) for r in out.filter("piece = 1").collect())
    assert first == [(1, "sentence"), (1, "sentence"), (4, "none"), (6, "sentence")]
    assert out.filter("char_length(text) > 900 or overlap > 91").count() == 0
    assert S.split_items(df.limit(0), kind=F.lit("k"), item_id=F.col("id"), text=F.col("text"), limit=F.col("limit")).count() == 0


# Answers

PROMPT = "Please grade the disclosed AI adoption below and explain.\n\nEXTRACT\nWe use speech recognition for claims triage in our northern plants. Sales fell by 5.2 percent in 2019."


@pytest.mark.parametrize("answer,want", [
    (None, "empty"), ("", "empty"), (" ​\xa0", "empty"), ("N/A", "empty"), ("{}", "empty"), ("```json\n```", "empty"), ('{"score": null, "explanation": ""}', "empty"), ("<answer></answer>", "empty"),
    ("I'm sorry, but I cannot comply with that request.", "refusal"), ('{"error": "I must respectfully decline."}', "refusal"), ("I’d rather not produce a classification for this text.", "refusal"),
    (PROMPT, "copied_question"), ("We used speech recognition for claims triage in our northern plants. Sales fell by 5.2 percent in 2019.", "copied_question"),
    ('{"score": 2, "explan', "truncated"), ("```json\n{\"score\": 3}", "truncated"), ("The filing describes a tool that is already", None), ("将来の計画はこの評価に", "other_language"),
    ("Die Einstufung lautet 2, weil das Unternehmen ein Sprachmodell bereits verwendet und Ergebnisse nennt.", "other_language"), ("抜粋には試験の記述しかないため、限られた利用と判断しました。", "other_language"),
    ("The filing describes a running tool. The company cannot quantify its benefit.", None), ('The decisive sentence reads: "We use speech recognition for claims triage in our northern plants." It is specific.', None),
    ('{"score": 1, "explanation": "Management declined to name a date."}', None), ("Score 1 was read from the reply (no current use).", None),
])
def test_defect(answer, want):
    assert R.defect(answer, PROMPT) == want


FOREIGN = {
    "ru": "Оценка равна двум, потому что компания уже использует языковую модель и сообщает о результатах.", "uk": "Оцінка дорівнює двом, тому що компанія вже використовує модель і повідомляє про це.", "el": "Η βαθμολογία είναι δύο επειδή η εταιρεία χρησιμοποιεί ήδη το μοντέλο.",
    "ko": "회사가 이미 언어 모델을 사용하고 있으므로 점수는 2점입니다.", "ar": "الدرجة هي اثنان لأن الشركة تستخدم النموذج بالفعل في هذه المصانع.", "fa": "امتیاز دو است زیرا شرکت از این مدل در کارخانه استفاده می کند.", "he": "הציון הוא שתיים כי החברה כבר משתמשת במודל.", "hi": "कंपनी पहले से ही भाषा मॉडल का उपयोग कर रही है।", "th": "บริษัทใช้แบบจำลองภาษาอยู่แล้ว",
    "pl": "Ocena wynosi 2, ponieważ spółka już używa modelu językowego i nie jest to tylko plan.", "sv": "Betyget är 2 eftersom företaget redan använder en språkmodell och det är inte bara en plan.", "da": "Karakteren er 2, fordi selskabet allerede bruger en sprogmodel, og det er ikke kun en plan.",
    "fi": "Arvosana on 2, koska yhtiö käyttää jo kielimallia ja se ei ole vain suunnitelma.", "tr": "Puan 2 olarak verildi çünkü şirket bu modeli zaten kullanıyor ve bu sadece bir plan değil.", "cs": "Známka je 2, protože společnost již používá jazykový model a není to jen plán.", "hu": "Az osztályzat 2, mert a vállalat már használ egy nyelvi modellt, és ez nem csak terv.", "vi": "Điểm là 2 vì công ty đã sử dụng mô hình này và đây không chỉ là kế hoạch.",
}


@pytest.mark.parametrize("lang", sorted(FOREIGN))
def test_answer_in_any_language(lang):
    answer = "The filing describes a running tool. The company cannot quantify its benefit."
    assert R.defect(FOREIGN[lang], PROMPT) == "other_language" and R.defect(answer, FOREIGN[lang]) == "other_language"
    assert not R.other_language(FOREIGN[lang], FOREIGN[lang])
    assert R.other_language(FOREIGN[lang], FOREIGN["pl" if lang in ("ru", "uk") else "ru"]) and R.other_language(FOREIGN[lang], FOREIGN["hu" if lang == "pl" else "pl"])


def test_languages_of_one_script():
    assert R.other_language(FOREIGN["uk"], FOREIGN["ru"]) and R.other_language(FOREIGN["fa"], FOREIGN["ar"]) and R.other_language(FOREIGN["fi"], FOREIGN["sv"])
    for answer in ("No plan, no pilot.", "β, γ and δ", "AI: 2", "Sales, costs, plants, boards."):
        assert not R.other_language(answer, PROMPT)
    assert not R.other_language("AI, OCR, ERP", FOREIGN["ru"])


def test_answer_behind_a_score():
    for raw in ("2", " 2\n", "**2**", "Score: 2", '{"score": 2}'):
        assert R.answer_of(raw, "why") == "why"
    for raw in (None, "", "The score is 2 because.", '{"score": 2, "explan'):
        assert R.answer_of(raw, "why") == raw


def test_defects_table(spark):
    whole = "The tool is used by Acme Corp. Ltd. in all plants of the group."
    rows = [(1, PROMPT, whole, None), (2, PROMPT, whole[:30], None), (3, None, None, None), (4, PROMPT, "1", None), (5, None, "The tool is in use.", "x"), (6, PROMPT, "x" * 200_000 + ".", None), (6, PROMPT, "", None)]
    df = spark.createDataFrame(rows, "id long, prompt string, raw string, why string").withColumn("answer", F.lit("clash"))
    out = R.defects(df, row_id="id", prompt=F.col("prompt"), raw=F.col("raw"), explanation=F.col("why"))
    assert sorted(map(tuple, out.collect())) == [(2, "truncated"), (3, "empty"), (4, "empty"), (6, "empty")]
    assert R.defects(df.limit(0), row_id="id", prompt=F.col("prompt"), raw=F.col("raw"), explanation=F.col("why")).count() == 0


# Mixes


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [rng.randint(0, 2000) for _ in range(3000)]
    chances = [0.37] * 3000
    out = X.flight(sizes, chances, random.Random(2))
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(chances)) and sum(p * s for p, s in zip(out, sizes)) == pytest.approx(sum(p * s for p, s in zip(chances, sizes)))
    assert abs(sum(p * s for p, s in zip(X.landing(out, random.Random(3)), sizes)) - sum(p * s for p, s in zip(chances, sizes))) <= 2000


def test_chances_are_kept():
    n = [0] * 20
    for seed in range(400):
        out = X.landing(X.flight([1] * 20, [0.3] * 20, rng := random.Random(seed)), rng)
        n = [a + b for a, b in zip(n, out)]
    assert all(70 < x < 175 for x in n) and sum(n) == pytest.approx(400 * 6)


def test_equal_and_zero_sizes():
    out = X.flight([0] * 50 + [7] * 50, [0.5] * 100, random.Random(0))
    assert sum(0 < p < 1 for p in out) <= 2 and sum(out) == pytest.approx(50)


@pytest.mark.parametrize("block", [20_000, 40])
def test_mix(spark, block):
    rng = random.Random(9)
    docs = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), rng.randint(0, 900)) for i in range(2000)] + [(5000, "a", None)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    plans = spark.createDataFrame([("p", "a", 3.0, 2), ("p", "b", 1.0, 40), ("p", "c", 1.0, 1), ("p", "none", 1.0, 5), ("q", "a", 1.0, None), ("q", None, None, 1)], "plan_id string, source string, target_weight double, max_repeats int")
    plan = X.mix_plan(sizes, plans)
    mixed = X.mix_sources(sizes, plan, block=block)
    rows = {(r["plan_id"], r["source"]): r for r in X.mix_report(plan, mixed).collect()}
    assert all(r["capped"] == r["exhausted"] for r in rows.values())
    total = sum(n or 0 for _, _, n in docs)
    assert rows["p", "a"]["taken_tokens"] == pytest.approx(total / 2, abs=1000) and rows["p", "b"]["taken_tokens"] == pytest.approx(total / 6, abs=1000)
    assert rows["p", "c"]["capped"] and rows["p", "none"]["capped"] and rows["q", "a"]["capped"] and not rows["p", "a"]["capped"]
    assert rows["p", "c"]["taken_tokens"] == rows["p", "c"]["available"]
    assert all(r["most_repeats"] <= r["max_repeats"] for r in rows.values())
    again = X.mix_sources(sizes.repartition(7), plan, block=block)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_empty_mix(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    plans = spark.createDataFrame([("p", "a", 1.0, 2)], "plan_id string, source string, target_weight double, max_repeats int")
    plan = X.mix_plan(sizes, plans)
    assert X.mix_sources(sizes, plan).count() == 0
    assert [(r["capped"], r["exhausted"]) for r in X.mix_report(plan, X.mix_sources(sizes, plan)).collect()] == [(False, False)]


# Languages

TEXTS = {
    "en": ["The company recorded an impairment at the plant.", "We expect revenue to grow next year.", "Our board reviews the risks of the business.", "The lease ends in the spring of that year.", "Customers may switch to other suppliers."],
    "de": ["Die Gesellschaft hat im Werk eine Wertminderung erfasst.", "Wir erwarten im nächsten Jahr höhere Umsätze.", "Der Vorstand prüft die Risiken des Geschäfts.", "Der Mietvertrag endet im Frühjahr dieses Jahres.", "Kunden können zu anderen Lieferanten wechseln."],
    "fr": ["La société a comptabilisé une dépréciation dans l'usine.", "Nous prévoyons une hausse du chiffre d'affaires.", "Le conseil examine les risques de l'entreprise.", "Le bail prend fin au printemps de cette année.", "Les clients peuvent changer de fournisseur."],
    "ja": ["当社は工場の減損損失を計上しました。", "来年度の売上高は増加すると見込んでいます。", "取締役会は事業のリスクを確認しています。", "賃貸借契約は春に終わります。", "お客様は他の仕入先に変えることがあります。"],
}


def body(rng, lang, n):
    return (" " if lang != "ja" else "").join(rng.choice(TEXTS[lang]) for _ in range(n))


def table(spark):
    rng = random.Random(3)
    rows = [(i, body(rng, lang, rng.randint(4, 9)), lang) for i, lang in enumerate(rng.choices(["en", "en", "de", "fr", "ja"], k=300))]
    en, de, fr = (body(rng, x, 4) for x in ("en", "de", "fr"))
    special = [
        (1000, en, None), (1001, en, " "), (1002, de, "UND"), (1003, de, "eng"), (1004, de, "de_AT"), (1005, de, "GER"), (1006, en + " " + de, "en"), (1007, en + " " + fr + " " + de, "fr"),
        (1008, en + ' The motto is "immer weiter vorwärts". ' + en, "en"), (1009, None, None), (1010, "", "en"), (1011, "* * * 12,5 | 3", None), (1012, en + " " + TEXTS["de"][0], "en"), (1012, en + " " + TEXTS["de"][0], "en"),
    ]
    return spark.createDataFrame(rows + special, "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))


def test_languages(spark):
    found = L.identify(table(spark), "doc_id", "text", "lang")
    rows = {r["doc_id"]: r for r in found.collect()}
    usual = [r for i, r in rows.items() if i < 1000]
    assert sum(r["label"] == r["lang"] for r in usual) >= 0.99 * len(usual)
    got = sorted(tuple(r) for r in L.issues(found, "doc_id").filter("doc_id >= 1000").collect())
    want = [(1000, "missing", "en"), (1001, "missing", "en"), (1002, "missing", "de"), (1003, "wrong", "de"), (1006, "mixed", "de"), (1006, "mixed", "en"), (1007, "mixed", "de"), (1007, "mixed", "en"), (1007, "mixed", "fr")]
    assert got == want
    assert rows[1009]["lang"] is None and rows[1010]["passages"] == [] and 0 < rows[1000]["confidence"] <= 1


def test_language_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(df, "doc_id", "text", "lang").count() == 0
    unlabelled = spark.createDataFrame([(1, "some text here", None)], "doc_id long, text string, lang string")
    assert L.identify(unlabelled, "doc_id", "text", "lang").first()["lang"] == "und"


def test_rare_label(spark):
    rng = random.Random(5)
    rows = [(i, body(rng, "en", 3), "englsh" if i < 3 else "en") for i in range(6000)] + [(6000 + i, body(rng, "de", 4), "de") for i in range(9)]
    rows += [(7000, body(rng, "de", 4), None), (7001, body(rng, "de", 4), "en"), (7002, body(rng, "en", 4) + " " + body(rng, "de", 4), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, "text", "lang", "doc_id")
    assert model.labels == ["de", "en"]
    got = L.issues(L.identify(df, "doc_id", "text", "lang", model), "doc_id").collect()
    assert sorted(map(tuple, got)) == [(i, "wrong", "en") for i in range(3)] + [(7000, "missing", "de"), (7001, "wrong", "de"), (7002, "mixed", "de"), (7002, "mixed", "en")]


def test_many_labels(spark):
    rng = random.Random(6)
    codes = "af ar az be bg bn bs ca cs cy da de el en eo es et eu fa fi fr ga gl hr hu hy id is it ja ka kk ko lt lv mk ms nl no pl pt ro ru sk sl sv ceb".split()
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñçşğåøł") for _ in range(rng.randint(2, 8))) for _ in range(60)] for x in codes}
    text = lambda x: " ".join(" ".join(rng.choice(words[x]) for _ in range(8)) + "." for _ in range(4))
    rows = [(100 * i + j, text(x), x) for i, x in enumerate(words) for j in range(20 if x == "ceb" else 24)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert model.labels == sorted(words)
    held = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(words)], "doc_id long, text string, lang string")
    assert L.identify(held, "doc_id", "text", "lang", model).filter("lang = label").count() == len(words)


def test_held_out_accuracy():
    rng = random.Random(11)
    train = [(body(rng, lang, 6), lang) for lang in TEXTS for _ in range(40)]
    noisy = [(t, rng.choice(list(TEXTS)) if rng.random() < 0.1 else lang) for t, lang in train]
    model = L.train([t for t, _ in noisy], [x for _, x in noisy])
    import pyarrow as pa

    test = [(body(rng, lang, 3), lang) for lang in TEXTS for _ in range(25)]
    got = [r[0] for r in L._passages(model, pa.array([t for t, _ in test]))]
    assert sum(a == b for a, (_, b) in zip(got, test)) >= 98
