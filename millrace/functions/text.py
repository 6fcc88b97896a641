"""String scalars. Lengths and positions count code points; white space is Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    """Stripped, non-empty paragraphs in order."""
    parts = F.transform(F.split(c, separator.replace("\n", r"\n")), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def suffix(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def strip_reasoning(c: Column) -> Column:
    """Without closed reasoning blocks, then stripped."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"```json|```", ""))


def first_bracketed(c: Column, kind: str = "[") -> Column:
    """From the first opening to the last closing bracket; null without such a stretch."""
    pattern = r"(?s)\[.*\]" if kind == "[" else r"(?s)\{.*\}"
    return F.nullif(F.regexp_extract(strip_fences(c), pattern, 0), F.lit(""))


def fenced_body(c: Column) -> Column:
    """The body of the first code fence, or the whole text without one."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.when(F.contains(c, F.lit("```")), strip(body)).otherwise(c)


def repaired_json(c: Column) -> Column:
    """Fence body with double quotes and without trailing commas."""
    quoted = F.replace(fenced_body(c), F.lit("'"), F.lit('"'))
    return F.regexp_replace(quoted, r",\s*([}\]])", "$1")


def csv_list(c: Column) -> Column:
    """Comma-separated text as a list of stripped, non-empty items."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(items, lambda x: F.length(x) > 0)


def string_or_list(json: Column, key: str) -> Column:
    """A JSON field that holds either comma-separated text or an array of strings."""
    as_list = F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>")
    return F.coalesce(F.filter(as_list, lambda x: F.length(strip(x)) > 0), csv_list(F.get_json_object(json, f"$.{key}")))


def underscored(c: Column) -> Column:
    return F.translate(c, " ", "_")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def without_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\-.]", "")


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def safe_round(c: Column, digits: int = 4) -> Column:
    """Rounded number, null where the text is no number or no finite one."""
    number = F.expr(f"try_cast({_name(c)} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.round(F.when(~F.isnan(number), number), digits)


def _name(c: str) -> str:
    return f"`{c}`"


def is_error_answer(c: Column) -> Column:
    return F.coalesce(c.startswith("ERROR"), F.lit(False))


def valid_answer(c: Column, least: int = 20, opening: int = 10, filler: str = "이렇게") -> Column:
    """Longer than ``least`` and without the filler word in its opening."""
    return F.coalesce((F.length(c) > least) & ~prefix(c, opening).contains(filler), F.lit(False))


def all_present(*columns: Column) -> Column:
    """True where every value is neither null nor empty."""
    return reduce(lambda a, b: a & b, [F.length(F.coalesce(c, F.lit(""))) > 0 for c in columns])


def replace_first(c: Column, old: str, new: str) -> Column:
    """The first occurrence replaced; it must be there, or the query fails."""
    at = F.locate(old, c)
    swapped = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))
    checked = F.assert_true(at > 0, F.lit(f"not found: {old}"))
    return F.when(checked.isNull(), swapped)


def numbered_id(n: Column, letter: str = "Q", width: int = 3) -> Column:
    return F.format_string(f"{letter}%0{width}d", n)


def fill_template(template: str, **values: Column) -> Column:
    """A template with {name} places, filled from columns; null values count as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not at:
            break
        pos, key = min(at)
        parts += [F.lit(rest[:pos]), F.coalesce(values[key].cast("string"), F.lit(""))]
        rest = rest[pos + len(key) + 2 :]
    return F.concat(*parts, F.lit(rest))


def keyword_tokens(c: Column, pattern: str = r"[가-힣]{2,}|\d+") -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def keyword_recall(gold: Column, pred: Column, pattern: str = r"[가-힣]{2,}|\d+") -> Column:
    """Share of the gold answer's keywords, with repeats, that stand in the prediction."""
    tokens = keyword_tokens(gold, pattern)
    hits = F.size(F.filter(tokens, lambda t: F.contains(F.coalesce(pred, F.lit("")), t)))
    return F.when(F.size(tokens) > 0, F.round(hits / F.size(tokens), 4)).otherwise(F.lit(0.0))
