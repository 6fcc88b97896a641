"""Personal data in Korean text: addresses, parcel numbers, bank accounts.

Everything is a column expression over one text column, without shuffles or Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPAN, around, let, spans
from .text import strip

# Names, words and patterns by which addresses, parcel numbers and accounts are known.
PROVINCES = (
    "서울특별시|서울|서울시|부산광역시|부산|대구광역시|대구|인천광역시|인천|광주광역시|광주|대전광역시|대전|울산광역시|울산|"
    "세종특별자치시|세종|경기도|경기|강원도|강원|충청북도|충북|충청남도|충남|전라북도|전북|전라남도|전남|경상북도|경북|경상남도|경남|"
    "제주특별자치도|제주|제주도"
)
CARRIERS = "CJ|우체국|한진|롯데|로젠|경동|합동|CJ대한통운|대한통운|호남|천일|대신|건영|일양"
BANKS = (
    "신한|국민|하나|우리|기업|농협|수협|씨티|카카오|토스|케이|제일|SC|산업|한국|신협|우체국|새마을|대구|부산|경남|광주|전북|제주|"
    "산림|수출입|KDB|KB|IBK|NH"
)
TRACKING_WORDS = "운송장번호|운송장|송장번호"
ACCOUNT_WORDS = r"(?:입금|환불)?\s*계좌|계좌번호"
ORDER_WORDS = r"주문\s*번호\s*[:：]?\s*|미검수\s*번호\s*[:：]?\s*"
NOT_ACCOUNT_WORDS = r"주문\s*번호[\s\-:：]*|운송장\s*번호\s*:?"
_DISTRICT = "[가-힣]+(?:시|군|구)"
_TOWN = "[가-힣]+(?:읍|면|동)"
_DETAIL = r"(?:\s*[가-힣0-9\s,\-()]+)?"
ROAD_ADDRESS = rf"(?:{PROVINCES})\s+{_DISTRICT}\s+(?:{_TOWN}\s+)?[가-힣0-9]+(?:로|길|대로)\s+\d+(?:-\d+)?(?:번길)?{_DETAIL}"
LOT_ADDRESS = rf"(?:{PROVINCES})\s+{_DISTRICT}\s+{_TOWN}\s+(?:[가-힣]+리\s+)?(?:산\s*)?\d+(?:-\d+)?{_DETAIL}"
#: Road addresses are tried first at every place.
ADDRESS = f"(?:{ROAD_ADDRESS})|(?:{LOT_ADDRESS})"

_CARRIER = rf"(?i)(?:{TRACKING_WORDS})|(?:{CARRIERS})(?:\s*택배)?"
_BANK = rf"(?i)(?:{BANKS})(?:\s*(?:은행|뱅크))?"
PARCEL = r"(?<!\d)(?:\d{4}(?:[-\s]?\d{4}){2}|(?i:[A-Z]{2}\d{9}[A-Z]{0,2})|\d{9,16})(?!\d)"
AFTER_WORD = rf"(?i:{ACCOUNT_WORDS})[\s:]*[^\d]*(\d[\d\s-]{{8,24}}\d)(?![\d-])"
AFTER_BANK = rf"(?i:(?:{BANKS})(?:\s*(?:은행|뱅크))?)\s*[^\d]*(\d[\d\s-]*\d)(?![\d-])"
BARE_ACCOUNT = r"(?<!\d)\d{10,14}(?!\d)"
# End of the fixed values.


def addresses(text: Column) -> Column:
    """All addresses in order, stripped; repeats are kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), F.lit(0))
    return F.transform(found, strip)


def _window_holds(digits: Column, width: int, valid) -> Column:
    windows = F.sequence(F.lit(1), F.length(digits) - width + 1)
    return F.when(F.length(digits) >= width, F.exists(windows, lambda i: valid(F.substring(digits, i, F.lit(width))))).otherwise(False)


def _between(c: Column, low: int, high: int) -> Column:
    return c.try_cast("int").between(low, high)


def may_be_date(digits: Column) -> Column:
    """Eight digits in a row could be year, month and day, or six could be year, month and day."""

    def eight(w: Column) -> Column:
        return w.rlike(r"^\d{8}$") & _between(F.substring(w, 1, 4), 1900, 2100) & _between(F.substring(w, 5, 2), 1, 12) & _between(F.substring(w, 7, 2), 1, 31)

    def six(w: Column) -> Column:
        return w.rlike(r"^\d{6}$") & _between(F.substring(w, 3, 2), 1, 12) & _between(F.substring(w, 5, 2), 1, 31)

    digits = F.trim(digits)
    return F.coalesce(_window_holds(digits, 8, eight) | _window_holds(digits, 6, six), F.lit(False))


def tracking_spans(text: Column) -> Column:
    """Parcel numbers with a carrier's or a parcel word near, and no order word before."""
    text = F.coalesce(text, F.lit(""))

    def good(s: Column) -> Column:
        before, after = around(text, s, 30, 30)
        length = F.length(F.regexp_replace(s["value"], r"(?U)[\s\-.]", ""))
        near = F.concat(F.lower(before), F.lower(after)).rlike(_CARRIER) | s["value"].rlike(_CARRIER)
        return length.between(8, 16) & ~F.lower(before).rlike(f"(?i){ORDER_WORDS}") & near

    return F.filter(spans(text, PARCEL), good)


def account_spans(text: Column) -> Column:
    """Account numbers as digits: after an account word, after a bank, or bare near either."""
    text = F.coalesce(text, F.lit(""))

    def digits(s: Column) -> Column:
        return F.struct(F.regexp_replace(s["value"], r"(?U)\D", "").alias("value"), s["start"].alias("start"), s["stop"].alias("stop"))

    def sized(found: Column) -> Column:
        return F.filter(F.transform(found, digits), lambda s: F.length(s["value"]).between(10, 14))

    def bare_ok(s: Column) -> Column:
        before, _ = around(text, s, 30, 0)
        left, right = around(text, s, 20, 20)
        context = F.concat(left, s["value"], right)
        dated = (F.length(s["value"]) == 10) & may_be_date(s["value"])
        return ~F.lower(before).rlike(f"(?i){NOT_ACCOUNT_WORDS}") & ~dated & (context.rlike(f"(?i){ACCOUNT_WORDS}") | context.rlike(_BANK))

    by_word = sized(spans(text, AFTER_WORD, 1, 1))
    by_bank = sized(spans(text, AFTER_BANK, 1, 1))
    bare = F.filter(spans(text, BARE_ACCOUNT), bare_ok)
    return F.array_distinct(F.concat(by_word, by_bank, bare)).cast(SPAN)


def values(found: Column) -> Column:
    return F.transform(found, lambda s: s["value"])


def resolved(text: Column, trackings: Column, accounts: Column, strict: bool = True) -> Column:
    """Struct of sorted distinct trackings and accounts, conflicts resolved.

    A value in both lists is an account if an account word or a bank stands in the 15
    characters before it. Strictly, only its first occurrence is judged so and later ones
    are trackings, and hyphenated numbers do not conflict with their digits; otherwise
    every occurrence is judged and digits are compared.
    """
    text = F.coalesce(text, F.lit(""))

    def plain(c: Column) -> Column:
        return c if strict else F.regexp_replace(c, r"(?U)\D", "")

    both = F.array_intersect(F.transform(trackings, lambda s: plain(s["value"])), values(accounts))
    start = F.struct(
        both.alias("open"), F.array().cast("array<string>").alias("t"), F.array().cast("array<string>").alias("a")
    )

    def step(acc: Column, s: Column) -> Column:
        before, _ = around(text, s, 15, 0)
        judged = F.array_contains(acc["open"], plain(s["value"]))
        is_account = judged & (F.lower(before).rlike(f"(?i){ACCOUNT_WORDS}") | F.lower(before).rlike(_BANK))
        still = F.array_remove(acc["open"], plain(s["value"])) if strict else acc["open"]
        return F.struct(
            F.when(judged, still).otherwise(acc["open"]).alias("open"),
            F.when(is_account, acc["t"]).otherwise(F.concat(acc["t"], F.array(s["value"]))).alias("t"),
            F.when(is_account, F.concat(acc["a"], F.array(plain(s["value"])))).otherwise(acc["a"]).alias("a"),
        )

    def joined(sorted_out: Column) -> Column:
        taken = F.concat(F.transform(sorted_out["t"], plain), sorted_out["a"])
        rest = F.array_except(values(accounts), taken)
        return F.struct(
            F.array_sort(F.array_distinct(sorted_out["t"])).alias("trackings"),
            F.array_sort(F.array_distinct(F.concat(sorted_out["a"], rest))).alias("accounts"),
        )

    return let(F.aggregate(trackings, start, step), joined)


#: Every number found holds nine digits with nothing but spaces and hyphens between.
NINE_DIGITS = r"(?U)(?:\d[\s-]*+){9}"


def detect_all(text: Column, strict: bool = True) -> Column:
    """Struct of sorted distinct trackings and accounts; most texts hold no long number and
    are passed over at the price of one search. Null gives empty lists."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    nothing = F.struct(none.alias("trackings"), none.alias("accounts"))
    return F.when(~text.rlike(NINE_DIGITS), nothing).otherwise(
        let(
            text,
            lambda t: let(F.struct(tracking_spans(t).alias("t"), account_spans(t).alias("a")), lambda found: resolved(t, found["t"], found["a"], strict)),
        )
    )


def keyword_near(text: Column, span: Column, words: list[str], reach: int) -> Column:
    """One of the words stands within so many characters of the span."""
    before, after = around(text, span, reach, reach)
    return reduce(lambda a, b: a | b, [F.concat(before, after).contains(w) for w in words])
