"""Broken prompt and response pairs.

Ordered rules look at an answer beside its question and name every defect they
find: ``empty``, ``refusal``, ``copy``, ``language``, ``truncated``. The rules need
Unicode composition and sentence-wise decisions, so they run as one Arrow UDF; the
answers are never shuffled, only the few found defects are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import endings
from .normal import normalise, pieces

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

# The words by which the rules know labels, messages and refusals.
LABEL = (
    r"(?:질문|문제|문항|답변?|응답|정답|결론|요약|정리하면|정리|참고|question|answer|response|reply|output|final answer|q|a"
    r"|回答|答案|答|质问|質問|问题|trả lời|câu hỏi|respuesta|pregunta)"
)
GREETING = r"(?:네|예|음|아|글쎄요|yes|well|ok|okay|sure)"
MESSAGE = (
    r"(?:null|none|nan|nil|n/?a|undefined|empty|no (?:answer|response|output|content)|무응답|없음|해당 ?없음"
    r"|(?:error|fatal|exception|traceback|warning|오류|에러)\b[^\n]*+"
    r"|(?:http|status)[ :/]*[1-5]\d\d\b[^\n]*+|(?:[^\n.!?]|\.\d)*\btim(?:ed|e)[ -]?out\b(?:[^\n.!?]|\.\d)*+"
    r"|(?:connection|request|gateway|service|server)\b(?:[^\n.!?]|\.\d)*\b(?:refused|reset|failed|unavailable|closed)\b(?:[^\n.!?]|\.\d)*+)"
)
APOLOGY = (
    r"죄송|송구|미안|안타깝|유감|양해|이해를? (?:바랍|부탁)|다른 질문|궁금한 점|도움이 필요|감사합니다|필요하시면|말씀해 주"
    r"|\bsorry\b|apologi[sz]e|unfortunately|\bregret|feel free|let me know|other questions?|anything else|thank you"
    r"|すみません|申し訳|恐れ入り|残念|他にご?質問|ご了承|抱歉|对不起|對不起|很遗憾|其他问题|xin lỗi|rất tiếc|câu hỏi khác"
    r"|lo siento|lamento|lamentablemente|disculp|otra pregunta"
    r"|désolé|je regrette|malheureusement|n'hésitez pas|autre question|merci de|tut mir leid|leider|entschuldig|bedaure|andere fragen?|melden sie sich"
    r"|desculp|lamentavelmente|infelizmente|sinto muito|outra pergunta|mi dispiace|purtroppo|altra domanda|извините|сожалени|простите|другой вопрос|het spijt me|helaas|przepraszam|niestety|maaf|üzgünüm|maalesef"
)
REFUSAL = (
    r"(?:답|답변|응답|대답|판단|결론|도움|조언|안내|설명|의견|정보|말씀)\S{0,3} ?(?:\S+ ){0,3}?\S{0,8}?(?:어렵|못|없|않겠|않습니다|생략|제한|불가|거절|거부|곤란|삼가)"
    r"|(?:도와|도움을? ?)\S* ?드릴 수 (?:있는 범위를 벗어|없)|범위를 벗어"
    r"|(?:내용|사실|답|정보)\S{0,2} (?:정확히 |잘 )?(?:알지 못|알 수 없|모르|모릅)|잘 모르겠"
    r"|(?:근거|자료|정보|내용|답|문서)\S{0,2} ?(?:\S+ ){0,2}?(?:찾지 못|찾을 수 없|확인할 수 없|확인되지 않|부족|충분하지|나와 있지|포함되어 있지|없어)"
    r"|(?:전문가|의사|변호사)가 아니|인공지능|\bAI\b ?(?:모델|언어|도우미|비서|이므로|라서)|언어 ?모델"
    r"|(?:담당자|기관|전문가)\S* ?(?:와|에게|에)? ?(?:직접 )?(?:상담|문의)하(?:시기|여|세요|십시오)"
    r"|\b(?:cannot|can ?not|can't|could not|couldn't|unable to|not able to|won't|will not|must decline|decline to|refuse to)\b"
    r"[^.!?]{0,40}\b(?:assist|help|answer|respond|comply|provide|offer|discuss|advise|comment|say|determine|tell|share|support)"
    r"|\b(?:i'd|i would|we'd|we would) (?:rather|prefer) not\b|\bprefer not to\b|\bno comment\b|\bnot comfortable (?:answering|with|discussing)"
    r"|outside (?:what|of what|the scope|my)|beyond (?:my|the) (?:scope|ability|knowledge)|no answer (?:can|could)|not cover (?:it|this|that)"
    r"|\bas an? (?:ai|language model|artificial)|i (?:do not|don't) (?:know|have (?:enough|that|the) )|not enough (?:information|context)"
    r"|お答え(?:でき|出来|し(?:かね|ません))|回答(?:でき|を控え|は控え|いたしかね)|わかりません|分かりません|お手伝いでき|情報が(?:不足|見つかり|ありません)|専門家ではあり"
    r"|(?:无法|不能|無法|不便)(?:回答|提供|协助|帮助|给出|作答|判断)|不知道|没有(?:相关|足够)的?(?:信息|资料|内容)|超出了?我"
    r"|không thể (?:trả lời|giúp|hỗ trợ|cung cấp|đưa ra)|không biết|không có (?:đủ )?thông tin|ngoài phạm vi"
    r"|no (?:puedo|podemos|es posible) (?:responder|ayudar|contestar|ofrecer|dar|proporcionar)|no (?:lo )?s[ée]\b|no (?:dispongo|tengo) (?:de )?(?:suficiente )?informaci|fuera de (?:mi|lo que)"
    r"|je (?:ne sais pas|préfère ne pas|refuse)|hors de (?:mes|ma) |\b(?:weiß|wissen) (?:ich |wir )?(?:das |es )?(?:leider )?nicht|keine (?:ausreichenden )?informationen|lieber nicht"
    r"|não (?:sei|tenho informaç)|prefiro não|fora do meu|non (?:lo )?so\b|non ho (?:informazioni|abbastanza)|preferisco non|не знаю|нет (?:достаточной )?информации|отказываюсь"
    r"|weet het niet|nie mogę (?:odpowiedzieć|pomóc|udzielić)|nie wiem|tidak (?:dapat|bisa) (?:menjawab|membantu|memberikan)|tidak tahu|yanıt veremem|cevap veremem|bilmiyorum"
)
#: Refusals whose words stand apart: a sentence declines if it holds one of each.
REFUSAL_PARTS = (
    (r"\b(?:ne|n['’]) ?(?:peux|pouvons|puis|suis|sommes|dispose|disposons|ai|connais|sais)\b", r"\b(?:pas|aucune?)\b", r"\b(?:répondre|aider|fournir|donner|réponse|informations?|conseils?|dire|mesure|savoir)"),
    (r"\b(?:kann|können|könnte|darf|möchte|werde)\b", r"\b(?:nicht|keine?n?)\b", r"\b(?:beantworten|helfen|geben|antworten|sagen|unterstützen|weiterhelfen|auskunft|antwort)"),
    (r"\bnão (?:posso|podemos|consigo|é possível)\b", r"\b(?:responder|ajudar|fornecer|dar|informar|dizer)"),
    (r"\bnon (?:posso|possiamo|sono in grado|riesco)\b", r"\b(?:rispondere|aiutar|fornire|dare|dire)"),
    (r"\bне (?:могу|можем|могла? бы|в состоянии|имею)\b", r"(?:ответ|помочь|предостав|сказать|информац)"),
    (r"\bkan (?:ik|hier|u|je|deze|daar)\b", r"\b(?:niet|geen)\b", r"(?:antwoord|helpen|geven)"),
)
REPORTED = r"다는 (?:말|민원|의견|지적|소문|주장|보고)|라는 (?:말|민원|의견)|지만 |으나 |그러나|\bbut\b|\bhowever\b|although|しかし|ですが|但是|不过|nhưng|\bpero\b"
ECHO = (
    r"물어보신 ?내용은? ?(?:다음과 ?같습니다)?|질문(?:하신)? ?내용은?|다음과 ?같습니다|라는 ?(?:질문|물음)(?:입니다|이군요|이네요|이다)?|(?:에|에 ?대해|에 ?대하여) ?(?:답변|대답|설명|말씀)(?:을)? ?(?:드리겠습니다|하겠습니다|드립니다)"
    r"|질문|답변|문항|you asked|the question (?:is|was)|your question|question|answer|ご質問|質問|您的问题是|问题|câu hỏi|pregunta"
)
# End of the fixed values.

_FLAGS = regex.IGNORECASE | regex.V0
_think = regex.compile(r"<(think|thinking|reasoning|analysis)\b[^>]*>.*?(?:</\1>|\Z)", _FLAGS | regex.DOTALL)
_markup = regex.compile(r"<[/!]?[A-Za-z][^<>]*>|&(?:nbsp|lt|gt|amp|quot|#\d{1,5});|```[A-Za-z0-9]*|[*_`#>|~]+", _FLAGS)
_label = regex.compile(rf"^\W*{LABEL}\W{{0,4}}[:：.)]\W*|^{GREETING}\s*[,.!，、]\s*|^정리하면\s+", _FLAGS)
_bare = regex.compile(rf"^\W*(?:{LABEL}|{GREETING})\W*$", _FLAGS)
_message = regex.compile(rf"^\W*+{MESSAGE}\W*+$", _FLAGS)
_content = regex.compile(r"[\p{L}\p{N}]")
_sentence = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_apology = regex.compile(APOLOGY, _FLAGS)
_refusal = regex.compile(REFUSAL, _FLAGS)
_refusal_parts = [[regex.compile(x, _FLAGS) for x in parts] for parts in REFUSAL_PARTS]
_reported = regex.compile(REPORTED, _FLAGS)
_echo = regex.compile("|".join(normalise(x) if x.isalnum() else x.replace(" ?", "").replace(" ", "") for x in ECHO.split("|")), _FLAGS)
_scripts = {
    "hangul": regex.compile(r"\p{Hangul}"),
    "latin": regex.compile(r"\p{Latin}"),
    "kana": regex.compile(r"[\p{Hiragana}\p{Katakana}]"),
    "han": regex.compile(r"\p{Han}"),
    "other": regex.compile(r"[\p{Cyrillic}\p{Arabic}\p{Thai}\p{Hebrew}\p{Greek}\p{Devanagari}]"),
}
# Letters and small words of languages in Latin letters.
VIETNAMESE = r"[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"
SMALL_WORDS = {
    "en": "the of and to in is are at by for must will not do with from that when if you it this be on as or can",
    "es": "el la los las de del en que se hay debe debes luego por para con un una es si primero no al su lo como pero y",
    "de": "der die das und ist nicht mit den dem ein eine zu auf für von sie im sich werden wenn dann muss bei nach zuerst es oder",
    "fr": "le la les des et est un une du dans pour que qui sur pas vous il avec au aux puis doit faut si d'abord ne ce ou être",
    "pt": "o os as do da dos das em não uma um para com se que deve depois por mais ao na no é primeiro ou e você",
    "it": "il lo gli della del di che non per una un con si deve poi sono alla nel le la è e prima da come più",
    "nl": "de het een en van is niet op te dat met voor zijn aan moet dan eerst als bij naar u ik die er",
    "pl": "i w na się nie że do jest z to o po jak należy potem najpierw lub oraz przez dla",
    "tr": "ve bir bu için ile de da önce sonra gerekir olarak ne en çok daha ya eğer",
    "id": "yang dan di ke dari untuk dengan tidak harus pada adalah ini itu lalu atau jika akan kemudian",
    "sv": "och att det är en ett som på för inte med den av till du ska när om sedan först",
}
# End of the fixed values.
_vietnamese = regex.compile(VIETNAMESE, _FLAGS)
_latin_words = regex.compile(r"[\p{Latin}']+|[ñ¿¡]", _FLAGS)
_LANGUAGES_OF: dict[str, list[str]] = {"¿": ["es"], "¡": ["es"]}
for _name, _words in SMALL_WORDS.items():
    for _word in _words.split():
        _LANGUAGES_OF.setdefault(_word, []).append(_name)


_hangul_runs = regex.compile(r"[가-힣]+")
_asked = lru_cache(maxsize=4096)(normalise)


def answer_part(text: str) -> str:
    """The answer without reasoning blocks, markup and leading labels."""
    text = _markup.sub(" ", _think.sub(" ", text)).strip()
    for _ in range(3):
        cut = _label.sub("", text, count=1).strip()
        if cut == text:
            break
        text = cut
    return text


def is_empty(text: str) -> bool:
    body = _markup.sub(" ", _think.sub(" ", text)).strip()
    rest = answer_part(text)
    return not _content.search(rest) or bool(_bare.match(body)) or bool(_message.match(body)) or bool(_message.match(rest))


def is_refusal(body: str) -> bool:
    """Every sentence declines or is courtesy, and one at least declines."""
    declines = False
    for part in _sentence.split(body):
        letters = len(_content.findall(part))
        if letters < 4:
            continue
        if _refusal.search(part) or any(all(x.search(part) for x in parts) for parts in _refusal_parts):
            if _reported.search(_apology.sub(" ", part)) and not _apology.search(part):
                return False
            declines = True
        elif not _apology.search(part):
            return False
    return declines


def is_copy(question: str, body: str) -> bool:
    """Without the question and the words that announce it, nothing of weight is left."""
    asked, said = _asked(question), normalise(body)
    if len(asked) < 8 or not said:
        return False
    if asked in said:
        rest = _echo.sub("", said.replace(asked, " ")).replace(" ", "")
        return len(rest) <= max(6, min(12, len(asked) // 8))
    if len(said) >= 0.6 * len(asked) and said in asked:
        return True
    # Nearly the question again: a question of about its length that shares most of its runs.
    if len(said) > 1.3 * len(asked) or not (body.rstrip("\"'”’」』)").endswith(("?", "？")) or said[-3:] == asked[-3:]):
        return False
    again, before = pieces(said, 3), pieces(asked, 3)
    return len(again & before) >= 0.75 * max(len(again), 1) and len(again & before) >= 0.7 * len(before)


@lru_cache(maxsize=4096)
def language(text: str) -> tuple[str, int, dict[str, int]]:
    """The language with the most letters, the number of letters, and letters by script."""
    n = {k: len(v.findall(text)) for k, v in _scripts.items()}
    total = sum(n.values())
    asian = n["kana"] + n["han"]
    if n["hangul"] >= max(n["latin"], asian, n["other"]):
        return "ko", total, n
    if asian >= max(n["latin"], n["other"]):
        return ("ja" if 8 * n["kana"] >= asian else "zh"), total, n
    if n["other"] > n["latin"]:
        return "other", total, n
    if 20 * len(_vietnamese.findall(text)) >= n["latin"]:
        return "vi", total, n
    return latin_language(text), total, n


def latin_language(text: str) -> str:
    """The language whose small words a text in Latin letters has most of, words of several
    languages counting in parts; English unless another one clearly has more."""
    votes: dict[str, float] = {}
    for word in _latin_words.findall(text.lower()):
        for name in (named := _LANGUAGES_OF.get(word, ())):
            votes[name] = votes.get(name, 0.0) + 1 / len(named)
    best = max(sorted(votes), key=votes.get, default="en")
    return best if votes.get(best, 0) > 1.2 * votes.get("en", 0) + 1 else "en"


def other_language(question: str, body: str) -> bool:
    asked, asked_letters, _ = language(question)
    if asked == "ko" and 2 * sum(map(len, _hangul_runs.findall(body))) >= len(body) - body.count(" "):
        return False
    said, letters, n = language(body)
    if letters < 8 or asked_letters < 8 or asked == said:
        return False
    if asked == "ko":
        return 2 * n["hangul"] < letters
    if asked in ("ja", "zh"):
        return said not in ("ja", "zh") or abs(8 * n["kana"] - n["kana"] - n["han"]) > n["han"] // 4
    if 2 * n["latin"] >= letters:
        return letters >= 20
    return True


def other_defects(question: str | None, answer: str | None) -> list[str]:
    """All defects of one answer but a lost end, in the order of DEFECTS. Null texts count as
    empty, and what is empty has no answer for the other rules to look at."""
    question = unicodedata.normalize("NFC", question or "")
    answer = unicodedata.normalize("NFC", answer or "")
    if is_empty(answer):
        return ["empty"]
    body = answer_part(answer)
    found = []
    if is_refusal(body):
        found.append("refusal")
    if is_copy(question, body):
        found.append("copy")
    if other_language(question, body):
        found.append("language")
    return found


def defects(question: str | None, answer: str | None) -> list[str]:
    """All defects of one answer, in the order of DEFECTS. Null texts count as empty."""
    found = other_defects(question, answer)
    if found != ["empty"] and endings.is_abrupt(unicodedata.normalize("NFC", answer or "")):
        found.append("truncated")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _defects_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for asked, said in parts:
        seen: dict[tuple, list[str]] = {}
        out = []
        for pair in zip(asked, said, strict=True):
            if (d := seen.get(pair)) is None:
                d = seen[pair] = defects(*pair)
            out.append(d)
        yield pd.Series(out, dtype=object)


def pair_defects(question: Column, answer: Column) -> Column:
    """Array of the defects of ``answer`` as a reply to ``question``."""
    return _defects_udf(question.cast("string"), answer.cast("string"))


def defective_pairs(
    df: DataFrame, key: str, question: str, answers: list[str], order: str | None = None
) -> DataFrame:
    """One row (key, field_name, defect, position) per defect of every answer column.

    Rows that share ``key`` were delivered more than once: the one with the greatest
    ``order`` counts, of equals the one with the greater answer defects. ``position``
    is 0 for the first defect that holds. Rows with a null key are kept under null.
    Empty input gives an empty result; columns not named are ignored.
    """
    when = F.col(order) if order else F.lit(0)
    found = df.select(
        F.col(key).alias("_k"),
        when.alias("_t"),
        *[pair_defects(F.col(question), F.col(a)).alias(f"_d{i}") for i, a in enumerate(answers)],
    )
    last = found.groupBy("_k").agg(
        F.max(F.struct("_t", *[f"_d{i}" for i in range(len(answers))])).alias("_m")
    )
    cases = F.array(*[F.struct(F.lit(a).alias("field_name"), F.col(f"_m._d{i}").alias("d")) for i, a in enumerate(answers)])
    return (
        last.select(F.col("_k"), F.inline(cases))
        .select("_k", "field_name", F.posexplode("d").alias("position", "defect"))
        .select(F.col("_k").alias(key), "field_name", "defect", "position")
    )
