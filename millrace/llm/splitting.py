"""Splitting oversized items at natural boundaries.

An item's boundaries (paragraph, line, sentence and word ends, in this order of
preference) lie in sorted arrays over its units. Prefix sums of the units' sizes turn
the size limit into a position; a binary search finds the last boundary under it, the
next piece begins the overlap earlier, and without a boundary the cut is hard. Units are
code points by default; ``sizes`` gives other units, as those of a tokenizer, by code point.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where pieces may end, best first.
BOUNDARIES = (
    regex.compile(r"(?:\r?\n)[^\S\n]*(?:\r?\n)\s*| \s*"),
    regex.compile(r"[\n\r\u0085 \v\f]\s*"),
    regex.compile(r"[.!?。！？…][)\]\"'”’」』】》]*\s+|[。！？][」』”]?(?=\S)|[;；]\s+"),
    regex.compile(r"\s+|[、，](?=\S)"),
)

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


Sizes = Callable[[str], np.ndarray]


def split_item(
    text: str | None, limit: int = 400, overlap: int = 80, sizes: Sizes | None = None
) -> list[tuple[int, int, int, str]]:
    """(piece_no, start, stop, text) of the pieces; one piece if the item is small enough.

    White space of any kind at both ends is no part of the item. Start and stop are code
    point positions in the stripped item. Every piece is at most ``limit`` units long and
    begins ``overlap`` units before the end of the piece before, or as near to that as
    whole units allow. ``sizes`` gives the units of each code point (by default 1 each).
    """
    text = (text or "").strip()
    if not text:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    sums = None if sizes is None else np.concatenate(([0], np.cumsum(sizes(text))))

    def reach(start: int) -> int:
        """The last position to which a piece from start may go."""
        if sums is None:
            return min(len(text), start + limit)
        return max(start + 1, int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1)

    def back(stop: int) -> int:
        if sums is None:
            return stop - overlap
        return int(np.searchsorted(sums, sums[stop] - overlap, side="left"))

    if reach(0) >= len(text):
        return [(0, 0, len(text), text)]
    levels = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    out: list[tuple[int, int, int, str]] = []
    start = 0
    while True:
        last = reach(start)
        if last >= len(text):
            out.append((len(out), start, len(text), text[start:]))
            return out
        # A piece must go beyond the overlap and the piece before, by half its room if it can.
        least = start + overlap + 1 if sums is None else int(np.searchsorted(sums, sums[start] + overlap, side="right"))
        least = max(least, out[-1][2] + 1 if out else 0)
        floor = least + max(0, last - least) // 2
        # Where there is no end in the upper half of the room, one in the lower half is better than none.
        found = (ends[k - 1] for low in (floor, least) for ends in levels if (k := bisect_right(ends, last)) > bisect_left(ends, low))
        stop = next(found, last)
        out.append((len(out), start, stop, text[start:stop]))
        start = max(back(stop), out[-1][1] + 1)


def pieces_of(text: Column, limit: int = 400, overlap: int = 80, sizes: Sizes | None = None) -> Column:
    """Array of the pieces of a text, one Arrow batch at a time. ``sizes`` runs on the executors."""

    @F.pandas_udf(PIECES)
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([split_item(t, limit, overlap, sizes) for t in part], dtype=object)

    return split(text)


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = 400, overlap: int = 80, sizes: Sizes | None = None) -> DataFrame:
    """One row (keys, piece_no, start, stop, text, n_pieces) per piece of each distinct item.

    Rows with equal keys and text count once. Null and blank items have no pieces.
    """
    items = df.select(*keys, F.col(text).alias("_x")).filter(F.length("_x") > 0).distinct()
    cut = items.withColumn("_p", pieces_of(F.col("_x"), limit, overlap, sizes)).drop("_x")
    return cut.select(*keys, F.size("_p").alias("n_pieces"), F.inline("_p"))
