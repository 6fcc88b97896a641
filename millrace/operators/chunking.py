"""Folding paragraphs into chunks, splitting recursively, joining chunks to contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import prefix
from .ranking import by_id, first_n, numbered


def fold_text(text: str | None, size: int = 400, overlap: int = 80, least: int = 80, separator: str = "\n\n") -> list[str]:
    """The chunks of one text, see ``folded``. White space of any Unicode kind is stripped."""
    chunks: list[str] = []
    now: list[str] = []
    length = 0
    for part in re.sub(r"\n{3,}", "\n\n", (text or "").strip()).split(separator):
        para = part.strip()
        if not para:
            continue
        if length + len(para) + 1 > size:
            whole = "\n".join(now)
            if length >= least:
                chunks.append(whole)
            # Paragraphs are stripped, so only the tail carried over can begin with white space.
            tail = whole[max(0, length - overlap) :].lstrip() if overlap else ""
            now, length = ([tail], len(tail)) if tail else ([], 0)
        now.append(para)
        length += len(para) + (len(now) > 1)
    if length >= least:
        chunks.append("\n".join(now))
    return chunks


def folded(text: Column, size: int = 400, overlap: int = 80, least: int = 80, separator: str = "\n\n") -> Column:
    """Array of chunks: paragraphs are added while they fit, then the chunk is given out
    if it is long enough, and its last ``overlap`` characters open the next one.

    A paragraph above the size is never split; a chunk too short is dropped but its end
    is carried on. Null gives an empty array. A fold in Catalyst copies all chunks so far at
    every paragraph, so whole Arrow batches are folded in time linear in the text.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fold_text(t, size, overlap, least, separator) for t in part], dtype=object)

    return fold(text)


def chunk_rows(df: DataFrame, keep: list[str], text: str, **parameters) -> DataFrame:
    """One row per chunk with the columns to keep: (keep, chunk_no, chunk)."""
    return df.select(*keep, F.posexplode(folded(F.col(text), **parameters)).alias("chunk_no", "chunk"))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Split at the first separator that occurs, split long parts by the next ones, and
    merge neighbours up to the size, carrying over at most the overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    here = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[here], separators[here + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    run: list[str] = []

    def flush(carry: bool) -> None:
        nonlocal run
        joined = sep.join(run).strip()
        if joined:
            out.append(joined)
        while run and carry and len(sep.join(run)) > overlap:
            run = run[1:]
        if not carry:
            run = []

    for part in parts:
        if len(part) > size and rest:
            if run:
                flush(False)
            out.extend(recursive_pieces(part, size, overlap, rest))
            continue
        if run and len(sep.join([*run, part])) > size:
            flush(True)
            while run and len(sep.join([*run, part])) > size:
                run = run[1:]
        run.append(part)
    if run:
        flush(False)
    return out


def recursively_split(text: Column, size: int = 400, overlap: int = 80, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> Column:
    """Array of pieces; recursion is beyond Catalyst, so whole batches go to Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: recursive_pieces(t or "", size, overlap, separators))

    return split(text)


def _id_bucket(order: str) -> Column:
    return by_id(order)


def block_contexts(df: DataFrame, category: str, order: str, text: str, source: str, block: int = 5, cut: int = 2000) -> DataFrame:
    """(category, block_no, context, source) of every ``block`` consecutive texts.

    Positions come from bucket counts, so that one category may hold most rows; a block's
    texts are few and are joined in one row. The source is that of the first text.
    """
    placed = numbered(df.select(category, order, text, source), [category], order, _id_bucket(order))
    blocks = placed.withColumn("block_no", F.floor((F.col("pos") - 1) / block).cast("bigint"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col(text).alias("t"))))
    return blocks.groupBy(category, "block_no").agg(
        prefix(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n"), cut).alias("context"),
        F.min_by(source, "pos").alias("source"),
    )


def first_contexts(df: DataFrame, category: str, order: str, text: str, n: int = 3, cut: int = 2000) -> DataFrame:
    """(category, context) of the first n texts of each category."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col(text).alias("t"))))
    return (
        first_n(df.select(category, order, text), [category], [order], n)
        .groupBy(category)
        .agg(prefix(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n"), cut).alias("context"))
    )
