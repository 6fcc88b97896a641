"""When is a text finished, and when does it break off?

The rules on answer pairs use all of what follows in Python; the operator on cut texts uses,
in SQL, what completes a sentence or note. Patterns look at the end of a text whose trailing
white space is gone, those on lines at whole lines.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow a finished sentence: white space, format characters, pictures.
_TRAILING = r"[\s\p{Z}\p{Cf}\p{So}\p{Sk}︎️ ]"
#: Only the start of a run is tried, or long runs would cost their square.
TRAILER = rf"(?<!{_TRAILING}){_TRAILING}+$"

#: Remains of a transfer that stopped inside an entity, a tag, an escape or a character.
BROKEN_CODE = (
    r"(?:&[A-Za-z#][A-Za-z0-9]{0,7}|&|</?[A-Za-z]{0,8}|\\[ux]?[0-9A-Fa-f]{0,3}|%[0-9A-F]|�|[ᄀ-ᅟ])$"
)

#: A number whose decimals are missing, a joining mark, an opening mark or a comma.
OPEN_END = r"(?:\d\.|\d,|[\-–—~·/+=&@#(\[{<「『“‘《〈,、，;；]|[A-Za-z0-9][\-–—]|\bRef\.?)$"

#: Sentence marks, with what closes after them.
FULL_STOP = r"(?:[.!?。！？…][)\]}\"'”’」』】》〉*_`]*|[)\]}\"”’」』】》〉`]|\*\*|~~~|```|</[A-Za-z0-9]+>)$"

#: A sentence mark that is no decimal point, with what closes after it.
STOPPED = r"(?:(?<![0-9])\.|[!?。！？…])[)\]}\"'”’」』】》〉*_`]*$"

#: Ends of finished Korean sentences without a full stop.
PREDICATE = (
    r"(?:니다|니까|시오|세요|에요|예요|어요|아요|해요|돼요|워요|와요|지요|네요|군요|나요|까요|는가|은가|인가|던가"
    r"|한다|된다|는다|있다|없다|였다|았다|었다|했다|됐다|이다|린다|난다|킨다|쓴다|친다|둔다|간다|온다|준다|같다|많다|[기길] 바람|요망|\s것)$"
)

#: Syllables with the final consonant that makes a noun of a verb.
_NOUN_FORM = "".join(chr(0xAC00 + 28 * i + 16) for i in range(399))

#: Finished note-style predicates: an object, then a noun form of a verb.
NOTE_STYLE = rf"(?:[을를]\s+\S*[가-힣][{_NOUN_FORM}]|(?:^|\n)[ \t]*(?:[-*•·]|\d{{1,3}}[.)])[^\n]*[을를] [{_NOUN_FORM}])$"

#: Stray particles behind a full stop, as careless editing leaves them.
STRAY = r"(?:[다요오까][.。!?](?:까지|만|도|등|은|는|이|가|을|를)+)$"

#: A finished line that names a value, as in "limit: 12.5 m".
VALUE_LINE = r"(?:^|\n)[^\n:：.。]{1,24}[:：]\s*[^\n.。]{0,20}?[\d.,]*\d\s?[A-Za-z%℃°㎍㎥㎡㎢㎏㎝㎞ℓ/³²μ가-힣]{1,5}$"

#: The last of several list items, a heading or a lone link.
LIST_ITEM = r"(?:^|\n)[ \t]*(?:[-*•·▪◦‣○●■□]|\d{1,3}[.)]|[①-⑳]|[가-하][.)]|[a-zA-Z][.)])[ \t]+[^\n]+\n+[ \t]*(?:[-*•·▪◦‣○●■□]|\d{1,3}[.)]|[①-⑳]|[가-하][.)]|[a-zA-Z][.)])[ \t]+[^\s][^\n]*$"
HEADING = r"(?:^|\n)(?:#{1,6} [^\n]+|\*\*[^\n]+\*\*:?|=+|-{3,}|\|[^\n]*\|)$"

#: A list whose items are objects and note-style verbs; its last item must be so too.
NOTE_LIST = (
    rf"(?:^|\n)[ \t]*(?:[-*•·]|\d{{1,3}}[.)])[ \t]+[^\n]*[을를] +[^\s]*[{_NOUN_FORM}]\.?\n+"
    rf"[ \t]*(?:[-*•·]|\d{{1,3}}[.)])[ \t]+[^\n]*[^{_NOUN_FORM}다요오.\n]$"
)

#: What the patterns of a few characters read; the others read whole lines.
SHORT = 24

_BROKEN_SHORT = f"{BROKEN_CODE}|{OPEN_END}"
_FINISHED_SHORT = f"{FULL_STOP}|{PREDICATE}|{STRAY}"
_FINISHED_LINES = f"{LIST_ITEM}|{HEADING}"
_PLAIN = r"^[^0-9]?[.!?。！？]$"

# Marks that come in pairs, and tags that must be closed.
CLOSED_BY = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "“": "”", "《": "》", "〈": "〉", "【": "】"}
TAGS = r"<(/?)(b|i|u|em|strong|code|pre|span|table|ul|ol|div)\b[^<>]*>"


def trimmed(text: Column) -> Column:
    """The text without trailing white space, format characters and pictures."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.right(text, F.lit(1)).rlike(TRAILER), F.regexp_replace(text, TRAILER, "")).otherwise(text)


def complete(text: Column) -> Column:
    """True where a trimmed text ends in a sentence mark, or in a predicate or note that needs none."""
    line = F.substring_index(text, "\n", -1)
    return F.right(text, F.lit(2)).rlike(_PLAIN) | F.right(text, F.lit(SHORT)).rlike(rf"{STOPPED}|{PREDICATE}|{STRAY}") | line.rlike(NOTE_STYLE)


_re = {
    name: regex.compile(pattern)
    for name, pattern in {
        "trailer": TRAILER, "plain": _PLAIN, "broken": _BROKEN_SHORT, "note_list": NOTE_LIST, "finished": _FINISHED_SHORT, "note": NOTE_STYLE, "value": VALUE_LINE,
        "lines": _FINISHED_LINES, "paired": "[" + regex.escape("".join(CLOSED_BY) + "".join(CLOSED_BY.values())) + "]", "tags": "(?i)" + TAGS, "quote": r'(?:^|\s)"\S[^"]*$',
    }.items()
}


def unclosed(text: str) -> bool:
    """A bracket or quotation of the last line, or a fence, formula or tag of the whole text,
    that nothing closes."""
    line = text[text.rfind("\n") + 1 :]
    waiting: list[str] = []
    number = dict.fromkeys(CLOSED_BY.values(), 0)
    for mark in _re["paired"].findall(line):
        if mark in CLOSED_BY:
            waiting.append(CLOSED_BY[mark])
            number[waiting[-1]] += 1
        elif number[mark]:
            while (last := waiting.pop()) != mark:
                number[last] -= 1
            number[mark] -= 1
    if waiting or text.count("```") % 2 or text.count("$$") % 2:
        return True
    if line.count('"') % 2 and _re["quote"].search(line):
        return True
    if "<" not in text:
        return False
    deep: dict[str, int] = {}
    for end, name in _re["tags"].findall(text):
        deep[name.lower()] = max(0, deep.get(name.lower(), 0) + (-1 if end else 1))
    return any(deep.values())


def last_lines(text: str) -> str:
    """The last line and the one before that is not blank."""
    at = text.rfind("\n")
    before = text[: at + 1].rstrip()
    return text[before.rfind("\n") + 1 :] if at >= 0 else text


def is_abrupt(text: str) -> bool:
    """True if a text shows no finished end, or a broken one; it need not be trimmed."""
    if text[-1:].isspace() or not text[-1:].isalnum():
        text = _re["trailer"].sub("", text)
    if not text:
        return False
    if unclosed(text):
        return True
    if _re["plain"].search(text[-2:]):
        return False
    short, lines = text[-SHORT:], last_lines(text)
    line = lines[lines.rfind("\n") + 1 :]
    if _re["broken"].search(short) or ("\n" in lines and _re["note_list"].search(lines)):
        return True
    return bool(
        not _re["finished"].search(short)
        and not _re["note"].search(line)
        and not ((":" in line or "：" in line) and _re["value"].search(lines))
        and not _re["lines"].search(lines)
    )
