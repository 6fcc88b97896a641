"""Matches with exact offsets, within Catalyst.

Spark extracts matches but not their places. Anchored at the end of the match before, a
pattern "gap, match" covers the text from its start, so the running sum of lengths is the
offset of every match, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<value:string,start:int,stop:int>>"


def spans(text: Column, pattern: str, groups: int = 0, value_group: int | None = None) -> Column:
    """Array of (value, start, stop) of all matches, left to right.

    Digits, letters and white space are Unicode's. ``pattern`` may use look-around and ``groups`` capturing groups of its own; with
    ``value_group`` the span is that of the group, found within its match from the right.
    """
    text = F.coalesce(text, F.lit(""))
    whole = rf"(?sU)\G(.*?)({pattern})"
    # A match with the gap before it is the whole of a step, so two scans give all three lengths.
    steps = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(whole), F.lit(2 if value_group is None else 2 + value_group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    items = F.arrays_zip(steps.alias("step"), inner.alias("value"))

    def step(acc: Column, m: Column) -> Column:
        stop = acc["at"] + F.length(m["step"])
        # A value group ends its match, but for what a look-ahead leaves outside.
        span = F.struct(m["value"].alias("value"), (stop - F.length(m["value"])).alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def around(text: Column, span: Column, before: int, after: int) -> tuple[Column, Column]:
    """The text before and after a span, up to so many characters."""
    start = F.greatest(span["start"] - before, F.lit(0))
    return F.substring(text, start + 1, span["start"] - start), F.substring(text, span["stop"] + 1, F.lit(after))
