"""Defective answers among prompt and response pairs.

The sentences of all answers are sorted (range-partitioned, so equal beginnings are neighbours) and each answer's last
sentence is compared with its neighbours there: where a longer one begins with it, the answer is a shortened version, and how
the longer one goes on tells whether it stops within a sentence. Lengths at which far more answers break off than at those
around them are length limits. A missing full stop alone decides nothing: it takes a longer version, a long common beginning
with a neighbour, or a limit. An answer's other defects are told by rules on itself and its prompt, in the same pass that
takes it apart, so that only sentences and the few undecided rows are shuffled.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import cut, partitions_for, spread

#: Sentences that one range of the sort should hold.
RANGE_ROWS = 200_000
#: Share of an answer's last sentence, and characters, that a neighbour must begin with to show that it breaks off.
COMMON_SHARE, COMMON_LEAST = 0.5, 8
#: A length is a limit if at least SPIKE_LEAST answers break off at it, and SPIKE_TIMES as many as at the lengths around on average.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND = 20, 8.0, 10
#: Share of an answer's words that stand in the prompt, and of its word pairs, from which it is a copy.
COPY_WORDS, COPY_PAIRS = 0.85, 0.6

# What stands for no content.
PLACEHOLDERS = ["", "null", "none", "na", "n a", "nan", "nil", "empty", "blank", "undefined", "no answer", "no answer provided", "no output", "no response", "not provided", "no content", "not available", "not applicable", "tbd", "todo", "missing", "keine", "ninguno", "aucun", "無", "なし", "无"]
# Names under which a score or its reasons are given.
FIELD_WORDS = ["score", "rating", "grade", "level", "label", "answer", "ai", "ai_score", "final", "explanation", "reason", "reasons", "reasoning", "justification", "json", "result", "response"]

# What makes an English sentence a refusal. One that speaks of the scorer or of its task, and declines an act of scoring.
SPEAKER = r"\b(?:i|i'm|i'd|i'll|i've|me|my|myself|(?:the|this) (?:assistant|model|system|chatbot|tool|request|task|question|prompt|query|instruction)|(?:your|that) (?:request|question|prompt|query)|an? (?:ai|language) (?:model|system|assistant))\b"
DECLINE = (
    r"(?:\b(?:can ?not|can't|could not|couldn't|will not|won't|would not|wouldn't|shall not|must not|may not|do not|don't|should not|shouldn't|cannot be|is not|isn't|am not|'m not|are not|aren't)(?! (?:find|see|identify|confirm|verify|detect|locate|quantify|mention|name|contain|describe|show|think|believe|know|change|count))\b"
    r"|\b(?:unable|declin(?:e|ed|ing)|refus(?:e|ed|ing)|abstain(?:ed|ing)?|refrain(?:ed|ing)?|withhold(?:ing)?|opt(?:ing)? out|pass on|stay(?:ing)? away|steer(?:ing)? clear|rather not|prefer not|leave (?:this|that|it|the field|the score|the rating) (?:open|blank|empty|out|to)|rul(?:e|es|ed) (?:this|that|it) out|keep(?:s)? me from|stop(?:s)? me from|prevent(?:s|ed)?|prohibit(?:s|ed)?|forbid(?:s|den)?|bar(?:s|red)?|violat(?:e|es|ing)|(?:goes|is|be) against|outside|beyond|do without|no (?:score|rating|grade|number|verdict|assessment|result|answer|classification|opinion|evaluation|response|output))\b)"
)
ACT = r"\b(?:scor(?:e|es|ing)|rat(?:e|ing|ings)|grad(?:e|es|ing)|assess(?:ing|ment|ments)?|evaluat(?:e|ing|ion|ions)|judg(?:e|ing|ment|ement)|classif(?:y|ying|ication)|answer(?:ing)?|respon(?:d|ding|se)|reply|comply|help|assist|verdict|opinions?|numbers?|labels?|results?|request|output|task|this one|perform|take part|engage|what i (?:can|am|do|may)|my (?:scope|remit|role|guidelines|policies|policy|rules|instructions|principles)|(?:the|our|content|usage) (?:guidelines|policies|policy|rules))\b"
#: The same of sentences without a speaker: a score that isn't given.
WITHOUT_SPEAKER = r"\bno (?:score|rating|grade|number|verdict|assessment|classification|evaluation)\b.{0,40}\b(?:given|provided|issued|produced|offered|assigned|come|returned|made|possible)\b|\bi (?:(?:must|have to|need to|will|would|shall|am going to|respectfully|politely|regretfully|therefore) ){0,3}(?:decline|refuse|abstain)\b(?! to (?:count|credit|treat))|^(?:sorry|apologies|regrettably|unfortunately)\b.{0,40}\b(?:can ?not|can't|unable|not able|not possible|decline)\b.{0,40}\b(?:score|rate|rating|grade|assess|help|answer|comply|request)\b"
# First-person refusals in other languages, in lower case.
REFUSALS = [
    r"\bich (?:kann|darf|werde|möchte|will) (?:\w+ ){0,6}(?:nicht|keine|keinen|kein)\b", r"\b(?:kann|darf|werde) ich (?:\w+ ){0,6}(?:nicht|keine|keinen|kein)\b", r"\bes tut mir leid\b", r"\bich (?:lehne|verzichte)\b", r"\bleider (?:kann|darf|bin) ich\b",
    r"\bje (?:ne (?:peux|suis|saurais|donnerai|vais|souhaite)|regrette|refuse|dois refuser|dois décliner|préfère ne pas|m'abstiens)\b", r"\bje suis (?:désolée?|dans l'impossibilité)\b", r"\bdésolée?,", r"\bil m'est impossible\b",
    r"\bno (?:puedo|voy a|me es posible|estoy en condiciones)\b", r"\b(?:lo siento|lamento)\b", r"\b(?:prefiero no|me niego|debo rechazar|me abstengo)\b",
    r"\bnão (?:posso|consigo|vou|estou autorizad[oa])\b", r"\b(?:sinto muito|lamento|recuso-me|prefiro não)\b", r"\bnon (?:posso|sono in grado|intendo|mi è possibile)\b", r"\b(?:mi dispiace|mi rifiuto|preferisco non|devo declinare)\b",
    r"\bik (?:kan|mag|wil|zal) (?:\w+ ){0,4}(?:niet|geen)\b", r"\b(?:kan|mag) ik (?:\w+ ){0,5}(?:niet|geen)\b", r"\bik (?:weiger|moet weigeren|onthoud me)\b", r"\bhet spijt me\b",
    r"\bnie (?:mogę|jestem w stanie|będę|podejmę|wolno mi|oceniam|udzielę)\b", r"\b(?:odmawiam|przykro mi|muszę odmówić)\b", r"\b(?:nemohu|nesmím|odmítám|nejsem schopen|je mi líto)\b", r"\b(?:nemôžem|odmietam|nie som schopný|je mi ľúto)\b",
    r"\b(?:nem (?:tudok|tudom|adhatok|fogok|áll módomban)|visszautasítom|elutasítom|sajnálom)\b", r"\b(?:nu (?:pot|voi|am voie)|refuz|îmi pare rău)\b",
    r"\b(?:jag (?:kan|får|vill|kommer) (?:\w+ ){0,3}inte|kan jag (?:\w+ ){0,3}inte|jag (?:avstår|vägrar|måste avböja)|avböjer jag)\b", r"\b(?:jeg (?:kan|må|vil) (?:\w+ ){0,3}ikke|kan jeg (?:\w+ ){0,3}ikke|jeg (?:afstår|avstår|nægter|nekter|må afvise|må avslå))\b",
    r"\b(?:en (?:voi|pysty|saa|aio)|kieltäydyn|valitettavasti en)\b", r"\b(?:üzgünüm|reddediyorum|veremem|yapamam|değerlendiremem|puanlayamam|yanıtlayamam)\b",
    r"\bя (?:\w+ ){0,3}(?:не могу|не буду|не вправе|не имею права|отказываюсь|вынужден|воздержусь)\b", r"\b(?:не могу|не вправе|вынужден отказать|отказываюсь|воздержусь)\b", r"\b(?:не можу|не буду|відмовляюся|змушений відмовити)\b", r"\b(?:δεν μπορώ|αρνούμαι|λυπάμαι)\b",
    "لا أستطيع", "لا يمكنني", "أعتذر", "أرفض", "אני לא יכול", "איני יכול", "क्षमा करें", "नहीं कर सकता", r"\b(?:saya tidak (?:dapat|bisa)|mohon maaf)\b", r"\b(?:tôi không thể|xin lỗi|tôi từ chối)\b",
    "申し訳", "お答えできません", "評価できません", "採点できません", "お断り", "差し控え", "いたしかねます", "抱歉", "对不起", "我无法", "我不能", "我拒绝", "恕难", "無法提供", "죄송", "수 없습니다", "거절", "삼가", "어렵습니다",
]
# A score that the answer states itself; with one it isn't a refusal.
STATED = r"(?:\b(?:score|rating|grade|level|mark|classification|assign(?:ed)?|rate(?:d)?|settled|chose|give)\b[^.!?\d]{0,25}|^\W*)\b[1-5]\b(?!\s*(?:to|or|-|–|through|,|and|\))\s*\(?[1-5])(?![.,]?\d)"

# Frequent short words of each language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "is", "that", "for", "with", "not", "are", "was", "were", "this", "from", "by", "which", "it", "as", "at", "be", "has", "have", "our", "its", "or", "an", "on", "will"],
    "de": ["der", "die", "das", "und", "nicht", "ein", "eine", "einer", "den", "dem", "des", "mit", "auf", "für", "ist", "sich", "wird", "wurde", "weil", "bei", "als", "auch", "nur", "von", "im", "zu", "ohne", "es"],
    "fr": ["l", "d", "qu", "n", "car", "le", "les", "des", "est", "une", "un", "dans", "pas", "que", "du", "et", "pour", "qui", "sur", "au", "aux", "ne", "cette", "été", "sont", "avec", "sans", "mais", "n'ont", "la", "plus", "ou", "par"],
    "es": ["el", "los", "las", "que", "una", "un", "del", "por", "se", "con", "para", "no", "es", "en", "y", "su", "como", "porque", "ya", "pero", "sin", "esta", "han", "al", "lo", "más", "sus", "solo"],
    "it": ["l", "il", "che", "di", "della", "del", "una", "un", "non", "sono", "per", "è", "gli", "nel", "alla", "con", "stati", "questa", "perché", "già", "senza", "si", "dei", "le", "come", "soltanto", "più", "dell", "e"],
    "pt": ["o", "os", "as", "que", "uma", "um", "do", "da", "não", "por", "com", "para", "em", "foram", "são", "já", "porque", "mas", "sem", "nesta", "ao", "se", "como", "apenas", "no", "na", "dos", "e"],
    "nl": ["de", "het", "een", "van", "en", "niet", "is", "dat", "voor", "met", "op", "zijn", "bij", "er", "die", "omdat", "wordt", "maar", "ook", "al", "aan", "alleen", "door", "zonder", "deze", "te", "naar", "om"],
}
# The same of further languages, which need three different words as evidence. Close relatives share a list or stay undecided between them.
MORE_FUNCTION_WORDS = {
    "pl": "i w z na do nie się jest że to jak ale za od przez dla po są oraz który która które już tylko jego być było może ponieważ bez przy lub także firma spółka",
    "cs": "a v z na se je že to jak ale za od pro po jsou který která které již jen být bylo může protože bez při nebo také není byl byla jako však podle společnost",
    "sk": "a v z na sa je že to ako ale za od pre po sú ktorý ktorá ktoré už len byť bolo môže pretože bez pri alebo tiež nie bol bola však podľa spoločnosť",
    "hu": "a az és nem hogy egy is van volt de csak már meg ez ezt azt mert vagy mint még nincs vannak lehet szerint által ki el kell amely ami",
    "ro": "și în de la nu este un o care pe cu din pentru că sunt mai dar ca a au fost sau doar deja fără prin această acest său ale al compania",
    "sv": "och att det är en som för på av med inte den till har om ett var men kan från vid eller utan bara redan detta också därför sig enligt företaget",
    "da": "og at det er en som for på af med ikke den til har om et var men kan fra ved eller uden kun allerede dette også fordi sig ifølge der",
    "no": "og at det er en som for på av med ikke den til har om et var men kan fra ved eller uten bare allerede dette også fordi seg ifølge selskapet",
    "is": "og að er sem á í ekki það við um til með en af fyrir var eru hefur þetta hún hann eða bara",
    "fi": "ja on ei että se ovat oli mutta kuin myös joka vain jo tai kun koska ilman tämä sen ole yhtiö mukaan sitä hän niin voi",
    "et": "ja on ei et see oli aga kui ka mis ainult juba või sest ilma selle ole ettevõte järgi ning kes seda",
    "lv": "un ir ka no ar uz par nav bet kas tikai jau vai jo bez šis tas arī lai pēc tā uzņēmums",
    "lt": "ir yra kad ne su į iš apie bet kuris tik jau ar nes be šis tai taip pat dėl pagal jis nėra bendrovė",
    "tr": "ve bir bu da de için ile olarak değil olan çok daha ama var yok gibi veya şirket ancak kadar sadece çünkü olduğu göre",
    "az": "və bir bu da də üçün ilə deyil olan çox daha amma var yox kimi və ya şirkət yalnız çünki görə",
    "hr": "i u na je se da nije su za od s koji koja koje ali samo već bez ili kao što bi biti jer prema kako društvo",
    "sl": "in v na je se da ni so za od s ki pa le že brez ali kot bi biti ker po kako podjetje tudi",
    "sq": "dhe në e të i një që është nuk me për nga por ka janë vetëm ose si kjo ky sepse pa",
    "ca": "i el la els les que de del un una per amb no és en són però sense com ja només aquesta aquest perquè més dels ha han",
    "id": "yang dan di ke dari untuk dengan tidak ini itu pada adalah akan telah sudah hanya karena oleh juga atau belum perusahaan dalam",
    "tl": "ang ng sa na mga ay at hindi ito para may lang dahil kung ni si nito kumpanya",
    "sw": "na ya wa kwa ni katika la za hii hiyo lakini kuwa si kama pia tu bila kwamba kampuni",
    "vi": "và của là không có trong cho với được các một này đã những vì chỉ từ để công ty nhưng khi",
    "ru": "и в не на что с по это как но из у за от для о к же только уже или так был была были компания которые который без при потому",
    "uk": "і в не на що з по це як але із у за від для про до же тільки вже або так був була були компанія які який без при тому та",
    "be": "і ў не на што з па гэта як але за ад для пра да толькі ўжо або быў была былі які якія без кампанія",
    "bg": "и в не на че с по това как но от за към само вече или така беше са компанията които който без при защото се да",
    "sr": "и у не на да с по то како али из за од само већ или је су био била компанија које који без при јер се није",
    "ar": "في من على إلى أن لا ما هذا هذه التي الذي عن مع كان هو هي قد لم أو ثم بعد قبل فقط لأن الشركة",
    "fa": "و در به از که این است را با برای آن نیست شده می بر تا یک اما یا هم فقط زیرا شرکت",
    "ur": "اور میں کے کی کا ہے سے کو نے نہیں یہ کہ پر بھی تھا ہیں ایک صرف کیونکہ کمپنی",
}
_MORE = {k: frozenset(v.split()) for k, v in MORE_FUNCTION_WORDS.items()}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _name, _group in (_SETS | _MORE).items():
    for _word in _group:
        _LANGUAGES_OF.setdefault(_word, []).append(_name)

_ENDS = ".!?。！？…।॥۔؟։።။។"
_CLOSERS = "\"'”’」』)）]*_`»"
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
_REFUSAL, _STATED, _NO_SPEAKER = re.compile("|".join(REFUSALS)), re.compile(STATED), re.compile(WITHOUT_SPEAKER)
_SPEAKER, _DECLINE, _ACT = re.compile(SPEAKER), re.compile(DECLINE), re.compile(ACT)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]”’»]*\s+|(?<=[。！？।؟])|[\r\n]+")
_CONTENT = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ABBREVIATED = re.compile(r"(?:\b(?:Inc|Corp|Co|Ltd|No|Nos|vs|approx|e\.g|i\.e|cf|Mr|Ms|Dr|St|Fig|Sec)|\b[A-Z])\.$")

# A full stop that need not end a sentence: after a digit (decimal point, thousands, numbering) or a further abbreviation. Only a length limit tells.
_DOUBTFUL = re.compile(r"(?:\d|\b(?:Jr|Sr|Prof|Gen|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|pp|Vol|Art|Dept|Intl|Bros|incl|excl|max|min|avg|etc|al|ca|bzw|z\.B|www))\.$")


def tokens(text: str) -> list[str]:
    """Words in lower case; each ideograph or kana is one."""
    return _TOKEN.findall(text.lower())


@functools.cache
def _script_of(c: str) -> str:
    name = unicodedata.name(c, "").split() or [""]
    first = name[1] if name[0] in ("FULLWIDTH", "HALFWIDTH") and len(name) > 1 else name[0]
    return "HAN" if first in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else first


_WORD = re.compile(r"[^\W\d_]+")
_FIVE_WORDS = re.compile(r"(?:[^\W\d_]{2,}(?:[\W\d_]+|$)(?:[^\W\d_](?:[\W\d_]+|$))*){5}")


def script(text: str) -> str | None:
    """Script of most letters, or None with too few: six, of Latin, which other scripts borrow from, five words."""
    if not text.isascii():
        count: Counter[str] = Counter()
        for c, n in Counter(text).items():
            if c.isalpha():
                count["LATIN" if c.isascii() else _script_of(c)] += n
        if not count:
            return None
        total = sum(count.values())
        if count["HAN"] > 0.3 * total:
            return "HAN"
        name, n = count.most_common(1)[0]
        if n <= 0.5 * total or n < 6:
            return None
        if name != "LATIN":
            return name
    return "LATIN" if _FIVE_WORDS.search(text) else None


def languages(text: str) -> frozenset[str]:
    """Languages that the text may be in, by script and function words; more than one where relatives are as likely, none
    where they don't tell."""
    if not text.isascii():
        kana = len(_KANA.findall(text))
        han = len(_HAN.findall(text))
        if kana + han and kana + han > 0.3 * sum(map(str.isalpha, text)):
            return frozenset(["ja" if kana > 0.1 * (kana + han) else "zh"])
    words = _WORD.findall(text.lower())
    count = Counter(filter(_LANGUAGES_OF.__contains__, words))
    hits, more = dict.fromkeys(_SETS, 0), dict.fromkeys(_MORE, 0)
    for w, n in count.items():
        for x in _LANGUAGES_OF[w]:
            if x in hits:
                hits[x] += n
            else:
                more[x] += n
    (best, name), (second, _) = sorted(((n, name) for name, n in hits.items()), reverse=True)[:2]
    top = max(best, *more.values())
    if best >= 2 and best >= 0.08 * len(words) and best > second * 1.15 and 1.15 * best >= top:
        return frozenset([name, *(x for x, n in more.items() if n * 1.15 >= top)])
    close = [x for x, n in (hits | more).items() if n * 1.15 >= top]
    sure = any(len((_SETS | _MORE)[x] & count.keys()) >= 3 for x in close) and top >= 0.12 * len(words)
    return frozenset(close) if sure else frozenset()


_KANA, _HAN = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]")
_ASKED, _OWN = functools.lru_cache(maxsize=1024)(languages), functools.lru_cache(maxsize=16)(languages)
_ENGLISH = frozenset(["en"])


def content(answer: str) -> str:
    """The answer's own words: of a JSON object the texts in it, without fences, tags and bullets."""
    body = _FENCE.sub(" ", answer) if "```" in answer else answer
    bare = body.strip()
    if bare[:1] in ("{", "["):
        try:
            parsed = json.loads(bare)
        except ValueError:
            parsed = None
        if isinstance(parsed, (dict, list)):
            values = list(parsed.values()) if isinstance(parsed, dict) else parsed
            return " ".join(v for v in values if isinstance(v, str))
        body = _FIELD.sub(" ", bare)
    return _TAG.sub(" ", body) if "<" in body else body


_FENCE, _FIELD = re.compile(r"```[a-zA-Z]*"), re.compile(r'"[A-Za-z_]+"\s*:')
_FIELDS = frozenset(FIELD_WORDS) | {"null"}


def _only_score(raw: str) -> bool:
    number = None
    for m in _CONTENT.finditer(raw.replace("_", " ")):
        word = m.group().lower()
        if word in _FIELDS:
            continue
        if number is not None or not word.isdigit() or len(word) > 2:
            return False
        number = word
    return number is not None and open_structure(raw) == ""


def answer_of(raw: str | None, explanation: str | None) -> str | None:
    """raw, or the explanation where raw is nothing but a score."""
    return explanation if raw is not None and _only_score(raw) else raw


def open_structure(answer: str) -> str:
    """The innermost bracket, quote or fence that is opened and never closed; empty if none."""
    if answer.count("```") % 2:
        return "```"
    body = re.sub(r"```[a-zA-Z]*", " ", answer).strip()
    if body[:1] not in "{[":
        return ""
    stack, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
    return '"' if quoted else stack[-1] if stack else ""


def is_empty(answer: str | None) -> bool:
    """Null, blank, invisible, a placeholder or a closed structure without content."""
    if answer is None:
        return True
    body = _FENCE.sub(" ", answer)
    if _FIELD.search(body):
        body = _FIELD.sub(" ", body)
    words, longest = [], max(map(len, _EMPTY))
    for m in _CONTENT.finditer(_TAG.sub(" ", body)):
        words.append(m.group().lower())
        if len(words) > longest or words[-1] not in _EMPTY_WORDS:
            return False
    return open_structure(answer) not in ('"', "{", "[") and (" ".join(words) in _EMPTY or all(w in _EMPTY for w in words))


_EMPTY = frozenset(PLACEHOLDERS)
_EMPTY_WORDS = frozenset(w for p in PLACEHOLDERS for w in p.split())


def is_refusal(answer: str) -> bool:
    """A sentence of it declines to score, and it states no score."""
    body = content(answer)
    foreign = _OWN(body) != _ENGLISH
    body = body.lower().replace("’", "'").replace("\n", " ")
    if foreign and _REFUSAL.search(body):
        return not _STATED.search(body)
    if not _DECLINE.search(body):
        return False
    for sentence in _SENTENCE.split(body):
        if _NO_SPEAKER.search(sentence) or (_SPEAKER.search(sentence) and (m := _DECLINE.search(sentence)) and (_ACT.search(sentence, m.start()) or _ACT.search(sentence))):
            return not _STATED.search(body)
    return False


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def is_copy(answer: str, prompt: str) -> bool:
    """Nearly all words and most pairs of adjacent words stand in the prompt: no reasons of the answer's own."""
    body = _SCORED.sub(" ", content(answer))
    body = _INTRODUCED.sub(" ", body)  # an introduction such as "The text says:"
    words = tokens(body)
    if len(words) < 5:
        return False
    low, misses = prompt.lower(), int((1 - COPY_WORDS) * len(words)) + 1
    for w in words:  # what isn't even part of a word there isn't a word of it
        if w not in low:
            misses -= 1
            if misses <= 0:
                return False
    asked = tokens(prompt)
    known, known_pairs = frozenset(asked), _pairs(asked)
    share = sum(w in known for w in words) / len(words)
    pairs = list(zip(words, words[1:]))
    shared = sum(p in known_pairs for p in pairs) / len(pairs)
    if share < COPY_WORDS or shared < COPY_PAIRS:
        return False
    # A sentence of the answer's own, however short, is a reason.
    for sentence in re.split(r"(?<=[.!?。！？])\s*", body):
        own = tokens(sentence)
        if len(own) >= 5 and sum(p in known_pairs for p in zip(own, own[1:])) < 0.34 * (len(own) - 1):
            return False
    return True


_SCORED = re.compile(r"^\W*(?:score|rating|answer)\W*\d\b", re.I)
_INTRODUCED = re.compile(r"^\s*(?:[^\W\d]+[ ]){0,4}[^\W\d]+:\s+")


def sentences(answer: str) -> list[str]:
    """The sentences and lines of an answer's content, without bullets and quotes around them. A full stop after a digit or
    an abbreviation ends none."""
    body = content(answer)
    out, low = [], 0
    for m in _SENTENCE.finditer(body):
        before = body[max(low, m.start() - 12) : m.start()]
        if before[-1:] != "." or not (_ABBREVIATED.search(before) or _DOUBTFUL.search(before)):
            out.append(body[low : m.start()])
            low = m.end()
    out.append(body[low:])
    return [x for x in (part.strip(_AROUND) for part in out) if x]


_AROUND = " \t-*•>\"'`{}[]()“”‘’"


def unfinished(answer: str) -> bool:
    """Has no mark at the end of a sentence as its last character."""
    body = content(answer) if open_structure(answer) == "" else answer
    body = body.strip().rstrip(_CLOSERS + " \t\n")
    return bool(body) and body[-1] not in _ENDS


def ending(answer: str) -> str:
    """How an answer stops: ``unfinished``, at a full stop that is ``doubtful`` or ``abbreviated``, or ``whole``."""
    if unfinished(answer):
        return "unfinished"
    text = answer.rstrip()
    return "abbreviated" if _ABBREVIATED.search(text) else "doubtful" if _DOUBTFUL.search(text) else "whole"


def is_truncated(how: str, goes_on: str | None, common: float, at_limit: bool) -> bool:
    """how: ending of the answer; goes_on: how a longer version of its last sentence continues, if there is one; common: the
    share of the sentence that a neighbour begins with; at_limit: the answer has the length of a limit.

    What a longer version adds must hold a letter or digit: one that adds the full stop only shows a whole sentence. A full
    stop after a digit or an abbreviation is no end if the version goes on, or at a limit.
    """
    if how == "whole":
        return False
    more = bool(goes_on) and any(c.isalnum() for c in goes_on)
    if how == "unfinished":
        return more or at_limit or (not goes_on and common >= COMMON_SHARE)
    inside = more and goes_on[:1].isalnum()
    return at_limit or inside or (how == "abbreviated" and more)


def other_language(answer: str, prompt: str) -> bool:
    """In another script than the prompt, or in a language that the prompt can't be in. Languages of one script are told
    apart as far as FUNCTION_WORDS and MORE_FUNCTION_WORDS know them; of Han, Japanese and Chinese."""
    body = content(answer)
    if not (body.isascii() and prompt.isascii()):
        own, asked = script(body), script(prompt)
        if own and asked and own != asked:
            return True
    mine = _OWN(body)
    return bool(mine) and bool(theirs := _ASKED(prompt)) and mine.isdisjoint(theirs)


def judge(answer: str | None, prompt: str | None) -> tuple[str | None, str]:
    """(defect, ending): the first defect that an answer has by itself. With an ending other than ``whole`` it may be
    truncated, which comes before ``other_language``."""
    if is_empty(answer):
        return "empty", "whole"
    if is_refusal(answer):
        return "refusal", "whole"
    if prompt and is_copy(answer, prompt):
        return "copied_question", "whole"
    if open_structure(answer):
        return "truncated", "whole"
    return "other_language" if prompt and other_language(answer, prompt) else None, ending(answer)


def defect(answer: str | None, prompt: str | None, goes_on: str | None = None, at_limit: bool = False, common: float = 0.0) -> str | None:
    """The first defect that applies given the evidence, or None."""
    found, how = judge(answer, prompt)
    return "truncated" if how != "whole" and is_truncated(how, goes_on, common, at_limit) else found


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.startswith(b[:middle]) else (low, middle - 1)
    return low


_NEAR = T.StructType([T.StructField("text", T.StringType()), T.StructField("tail", T.BooleanType()), T.StructField("goes_on", T.StringType()), T.StructField("common", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("range", T.IntegerType())])
_FIRST, _LAST = 1, 2


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tail in a sorted range how a longer text goes on and the longest common prefix with a neighbour; the first and
    the last text of the range come too, marked by place."""
    number = TaskContext.get().partitionId()
    waiting: list[list] = []  # tails that the texts since then begin with, not yet seen to go on with a letter
    last = None  # [text, tail, goes_on, common, place]
    done: list[list] = []

    def pack() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)] if done else [[] for _ in range(5)]
        types = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
        out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array([number] * len(done), pa.int32())], _NEAR.names)
        done.clear()
        return out

    def close(items: list[list]) -> None:
        done.extend(x for x in items if x[1] or x[4])

    for batch in batches:
        for text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is not None and text == last[0]:
                last[1] = last[1] or tail
                continue
            item = [text, tail, None, 0, 0 if last else _FIRST]
            if last is not None:
                item[3] = _shared(text, last[0])
                last[3] = max(last[3], item[3])
                waiting.append(last)
                open_still = []
                for w in waiting:
                    if text.startswith(w[0]):
                        more = text[len(w[0]) : len(w[0]) + 40]
                        if w[2] is None or any(c.isalnum() for c in more):
                            w[2] = more
                        if any(c.isalnum() for c in more):
                            close([w])
                        else:
                            open_still.append(w)
                    else:
                        close([w])
                waiting = open_still
            last = item
        if len(done) > 10_000:
            yield pack()
    if last is not None:
        last[4] |= _LAST
        close([*waiting, last])
    yield pack()


def shortened(texts: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """texts: (text, tail). (text, goes_on, common) of each distinct text that is a tail anywhere: the next 40 characters of
    a longer one that begins with it, if there is any, and the share of it that a neighbour in the order begins with.

    The texts are sorted by range. The first and the last of a range are compared with those of the ranges beside it.
    """
    spark = texts.sparkSession
    n = partitions_for(spark, texts.count(), range_rows)
    ordered = texts.select("text", "tail").repartitionByRange(n, "text").sortWithinPartitions("text")
    found = cut(ordered.mapInArrow(_in_order, _NEAR), "order")
    edges = found.filter("place > 0")
    order = Window.orderBy("range", "place")  # two rows of a range at most
    edges = edges.withColumns({"before": F.when(F.col("place").bitwiseAND(_FIRST) > 0, F.lag("text").over(order)), "after": F.when(F.col("place").bitwiseAND(_LAST) > 0, F.lead("text").over(order))}).filter("tail")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, goes_on, common, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                common = max(common, *(_shared(text, x) for x in (before, after) if x is not None), 0)
                if after is not None and after.startswith(text) and goes_on is None:
                    goes_on = after[len(text) : len(text) + 40]
                rows.append((text, goes_on, common))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["text", "goes_on", "common"])

    inner = found.filter("tail and place = 0").select("text", "goes_on", "common")
    outer = edges.select("text", "goes_on", "common", "before", "after").mapInArrow(beside, "text string, goes_on string, common int")
    share = F.when(F.col("common") >= COMMON_LEAST, F.col("common") / F.char_length("text")).otherwise(0.0)
    return inner.unionByName(outer).select("text", "goes_on", share.alias("common"))


def length_limits(broken: DataFrame) -> DataFrame:
    """broken: (length) of every answer that breaks off. (length): those that pile up.

    Whole answers don't belong here, as many equal ones would make a limit of their length.
    """
    counts = broken.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    near = counts.select(F.explode(F.sequence(F.col("length") - SPIKE_AROUND, F.col("length") + SPIKE_AROUND)).alias("length"), F.col("n").alias("m")).groupBy("length").agg(F.sum("m").alias("all"))
    around = (F.col("all") - F.col("n")) / (2 * SPIKE_AROUND)
    return counts.join(near, "length").filter((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * around)).select("length")


def defects(pairs: DataFrame, *, row_id: str, prompt: Column, raw: Column, explanation: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(row_id, defect) of every pair that has one: empty, refusal, copied_question, truncated or other_language.

    A null, empty or blank answer is ``empty``; with a null or empty prompt the answer can't be a copy or in another
    language. Very long answers are handled whole, repeated rows stay repeated, other columns aren't read, an empty table
    gives an empty result.
    """
    kind = pairs.schema[row_id].dataType
    fields = [("id", kind), ("row", T.BooleanType()), ("defect", T.StringType()), ("ending", T.StringType()), ("length", T.IntegerType()), ("broken", T.BooleanType()), ("tail", T.StringType()), ("texts", T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row with its own defect and its tail where it may be truncated, and a row of the batch's distinct sentences."""
        for batch in batches:
            defect_of, how_of, length, broken, tail_of, texts = [], [], [], [], [], set()
            for asked, r, e in zip(*(c.to_pylist() for c in batch.columns[1:])):
                answer = answer_of(r, e)
                found, how = judge(answer, asked)
                parts = sentences(answer) if answer and found not in ("empty", "refusal", "copied_question") else []
                texts.update(parts)
                if how != "whole" and not parts:
                    how = "whole"
                defect_of.append(found)
                how_of.append(how)
                length.append(len(answer) if answer else 0)
                broken.append(found == "truncated" or how == "unfinished")
                tail_of.append(parts[-1] if how != "whole" else None)
            n = len(defect_of)
            ids = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
            rest = [([True] * n + [False], pa.bool_()), (defect_of + [None], pa.string()), (how_of + [None], pa.string()), (length + [0], pa.int32()), (broken + [False], pa.bool_()), (tail_of + [None], pa.string()), ([None] * n + [sorted(texts)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in rest)], schema.names)

    # Judging costs far more than moving: few files are dealt out to all cores.
    given = spread(pairs.select(row_id, prompt.alias("prompt"), raw.alias("raw"), explanation.alias("explanation")), 4 * pairs.sparkSession.sparkContext.defaultParallelism)
    judged = cut(given.mapInArrow(take_apart, schema), "judged")
    rows = judged.filter("row")
    texts = judged.filter("not row").select(F.explode("texts").alias("text"), F.lit(False).alias("tail"))
    tails = rows.filter("tail is not null").select(F.col("tail").alias("text")).distinct().withColumn("tail", F.lit(True))
    keys = lambda c: [F.xxhash64(c).alias("__h1"), F.xxhash64(c, F.lit(1)).alias("__h2")]
    evidence = shortened(texts.unionByName(tails), range_rows).select(*keys("text"), "goes_on", "common")
    limits = F.broadcast(length_limits(rows.filter("broken").select("length")).withColumn("__limit", F.lit(True)))  # at most one row for SPIKE_LEAST answers, in practice a few
    open_rows = rows.filter("tail is not null").select("id", "defect", "ending", "length", *keys("tail")).join(evidence, ["__h1", "__h2"], "left").join(limits, "length", "left")
    more = F.coalesce(F.col("goes_on").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    at_limit = F.col("__limit").isNotNull()
    broken = F.when(F.col("ending") == "unfinished", more | at_limit | (F.col("goes_on").isNull() & (F.coalesce("common", F.lit(0.0)) >= COMMON_SHARE))).otherwise(at_limit | (more & ((F.col("ending") == "abbreviated") | F.col("goes_on").rlike(r"^[\p{L}\p{N}]"))))
    decided = rows.filter("tail is null").select("id", "defect").unionByName(open_rows.select("id", F.when(broken, "truncated").otherwise(F.col("defect")).alias("defect")))
    return decided.filter("defect is not null").select(F.col("id").alias(row_id), "defect")
