"""Same or near-same records across splits.

The rarest pieces of each evaluation question are indexed by hash. Training messages are
scanned once: pieces that a fixed-size filter lets through meet the index by an equi-join,
hits are tallied per question and message, and pairs with enough hits are verified by the
exact containment of the question in the message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normal import normalise, piece_rows, pieces, portions
from .overlap import may_hold, piece_filter, rarest_first, sketch
from .storage import kept


@F.pandas_udf(T.StringType())
def normal_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(normalise)


@F.pandas_udf(T.DoubleType())
def _containment(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for asked, said in parts:
        out = []
        for q, m in zip(asked, said, strict=True):
            p = pieces(q)
            out.append(len(p & pieces(m)) / len(p) if p else 0.0)
        yield pd.Series(out, dtype="float64")


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with equal normal form as one class: (id, norm) and (id, key)."""
    keyed = texts.withColumn("norm", normal_form("text")).filter("length(norm) >= 5").withColumn("_h", F.md5("norm"))
    classes = kept(keyed.groupBy("_h").agg(F.min("norm").alias("norm")).withColumn("id", F.monotonically_increasing_id()))
    members = keyed.select("key", "_h").distinct().join(classes.select("_h", "id"), "_h").select("id", "key")
    return classes.select("id", "norm"), members


def contained_pairs(evaluation: DataFrame, training: DataFrame, share: float = 0.75, hits: int = 4) -> DataFrame:
    """(eval_key, train_key, containment) for pairs where at least ``share`` of the pieces
    of the evaluation text are among those of one training text.

    Both inputs have (key, text); a key may have several texts, and a pair counts by its
    best. Null texts and texts of fewer than five letters and numbers have no pieces and
    match nothing. Texts with equal normal forms are compared once, however many there
    are. Empty inputs give an empty result.
    """
    questions, askers = _classes(evaluation)
    messages, holders = _classes(training)
    spark = evaluation.sparkSession
    frequency = spark.sparkContext.broadcast(sketch(questions))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = frequency.value
        for frame in portions(frames, "norm"):
            row, h, at, size = rarest_first(*piece_rows(frame["norm"].to_numpy()), rank)
            need = np.ceil(share * size).astype(np.int64)
            k = np.minimum(hits, need)
            some = at < size - need + k
            yield pd.DataFrame({"q": frame["id"].to_numpy()[row[some]], "k": k[some], "h": h[some]})

    indexed = kept(questions.mapInPandas(index, "q long, k int, h long"))
    frequency.unpersist()
    bitmap = spark.sparkContext.broadcast(piece_filter(indexed))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.value
        for frame in portions(frames, "norm"):
            row, h = piece_rows(frame["norm"].to_numpy())
            some = may_hold(bits, h)
            yield pd.DataFrame({"m": frame["id"].to_numpy()[row[some]], "h": h[some]})

    tallied = (
        messages.mapInPandas(scan, "m long, h long")
        .join(indexed, "h")
        .groupBy("q", "m", "k")
        .agg(F.count("*").alias("n"))
        .filter("n >= k")
        .select("q", "m")
    )
    verified = (
        tallied.join(questions.select(F.col("id").alias("q"), F.col("norm").alias("qn")), "q")
        .join(messages.select(F.col("id").alias("m"), F.col("norm").alias("mn")), "m")
        .withColumn("containment", _containment("qn", "mn"))
        .filter(F.col("containment") >= share)
        .select("q", "m", "containment")
    )
    return (
        verified.join(askers.select(F.col("id").alias("q"), F.col("key").alias("eval_key")), "q")
        .join(holders.select(F.col("id").alias("m"), F.col("key").alias("train_key")), "m")
        .groupBy("eval_key", "train_key")
        .agg(F.max("containment").alias("containment"))
    )


def user_messages(items: DataFrame, key: str, messages: str) -> DataFrame:
    """(key, text) of every message whose role is user in any letter case."""
    return (
        items.select(F.col(key).alias("key"), F.explode(messages).alias("m"))
        .filter(F.lower(F.trim("m.role")) == "user")
        .select("key", F.col("m.content").alias("text"))
    )
