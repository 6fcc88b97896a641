"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised evaluation texts runs once over every
normalised document. A shared run of ``least`` characters holds at least one of the
blocks taken from each evaluation text (blocks of half that length, one at every step of
half the length and one more), so the automaton needs one short pattern per block only; a
hit is widened to both sides and counts if the run is long enough. Offsets are mapped back
to the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import normalise
from .storage import kept

#: Characters of evaluation text in one automaton and on the driver at a time; more are
#: scanned for in further passes over the documents.
PASS_CHARS = 4_000_000


def _automaton(passages: list[tuple], least: int):
    import ahocorasick

    size = least // 2
    blocks: dict[str, list[tuple[int, int]]] = {}
    for n, (_, text) in enumerate(passages):
        if len(text) < least:
            continue
        for at in range(0, len(text) - size + 1, least - size + 1):
            blocks.setdefault(text[at : at + size], []).append((n, at))
    if not blocks:
        return None
    a = ahocorasick.Automaton()
    for block, where in blocks.items():
        a.add_word(block, where)
    a.make_automaton()
    return a


def shared_runs(automaton, passages: list[tuple], least: int, text: str) -> list[tuple[int, int, int, int]]:
    """Maximal shared runs (passage number, start in passage, start in text, length)."""
    size, done, runs = least // 2, {}, []
    for end, where in automaton.iter(text):
        start = end - size + 1
        for n, at in where:
            diagonal = (n, start - at)
            if done.get(diagonal, -1) >= end:
                continue
            passage, i, j = passages[n][1], at, start
            while i and j and passage[i - 1] == text[j - 1]:
                i, j = i - 1, j - 1
            k, m = at + size, end + 1
            while k < len(passage) and m < len(text) and passage[k] == text[m]:
                k, m = k + 1, m + 1
            done[diagonal] = m - 1
            if k - i >= least:
                runs.append((n, i, j, k - i))
    return runs


def original_offsets(text: str, start: int, length: int) -> tuple[int, int]:
    """The stretch of the original text whose normalised form holds the given run.

    Normalisation is not character-wise, so the bounds are found by bisection over the
    lengths of normalised beginnings; they reach no further than the run's first and
    last character with the marks between.
    """

    def first(n: int) -> int:
        low, high = 0, len(text)
        while low < high:
            mid = (low + high) // 2
            if len(normalise(text[:mid])) >= n:
                high = mid
            else:
                low = mid + 1
        return low

    return max(0, first(start + 1) - 1), first(start + length)


def _passes(passages: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple]]:
    """The normalised passages in portions of so many characters, or of one passage."""
    held: list[tuple] = []
    room = most
    for row in passages.select(key, text).toLocalIterator():
        normal = normalise(row[1])
        if room < len(normal) and held:
            yield held
            held, room = [], most
        held.append((row[0], normal))
        room -= len(normal)
    yield held


def leaks(
    documents: DataFrame, passages: DataFrame, doc_key: str, doc_text: str, passage_key: str, passage_text: str, least: int = 40, pass_chars: int = PASS_CHARS
) -> DataFrame:
    """(passage_key, doc_key, n_shared, doc_start, doc_end) for every document that holds
    ``least`` or more consecutive characters of a normalised evaluation text; the longest
    run counts. Null texts count as empty and share nothing; repeated documents come out
    once each; no passages or no documents give an empty result.

    The documents are scanned once for every ``pass_chars`` characters of evaluation text.
    The driver and the executors hold one such portion at a time: with more than one, the
    findings of a pass are written down before the next portion is read.
    """
    spark = documents.sparkSession
    key_type = passages.schema[passage_key].dataType.simpleString()
    doc_type = documents.schema[doc_key].dataType.simpleString()
    slim = documents.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).filter("length(t) > 0")
    schema = f"p {key_type}, d {doc_type}, n_shared int, doc_start int, doc_end int"

    def scanned(sent) -> DataFrame:
        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            automaton = _automaton(known, least)
            for frame in frames:
                out = []
                for d, t in zip(frame["d"], frame["t"], strict=True):
                    if automaton is None:
                        continue
                    best: dict[int, tuple[int, int]] = {}
                    for n, _, at, length in shared_runs(automaton, known, least, normalise(t)):
                        if length > best.get(n, (0, 0))[0]:
                            best[n] = (length, at)
                    out += [(known[n][0], d, length, *original_offsets(t, at, length)) for n, (length, at) in best.items()]
                yield pd.DataFrame(out, columns=["p", "d", "n_shared", "doc_start", "doc_end"])

        return slim.mapInPandas(scan, schema)

    portions = _passes(passages, passage_key, passage_text, pass_chars)
    portion, following = next(portions), next(portions, None)
    found = None
    while following is not None:
        sent = spark.sparkContext.broadcast(portion)
        part = kept(scanned(sent))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
        portion, following = following, next(portions, None)
    last = scanned(spark.sparkContext.broadcast(portion))
    found = last if found is None else found.unionByName(last)
    best = found.groupBy("p", "d").agg(F.max(F.struct("n_shared", "doc_start", "doc_end")).alias("m"))
    return best.select(F.col("p").alias(passage_key), F.col("d").alias(doc_key), "m.*")
