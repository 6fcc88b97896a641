"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import root
from .storage import kept

#: So many edges are joined in one task.
FEW = 1 << 18


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}
    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = root(parent, a), root(parent, b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [root(parent, n) for n in nodes]}, dtype="int64")


def components(edges: DataFrame, most_rounds: int = 50, few: int = FEW) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); a component is its least node.

    Each round joins every edge with the least neighbour of its end, so rows, not groups,
    are spread; the number of rounds grows with the logarithm of the longest chain. Self
    loops and repeated edges are allowed; no edges give an empty result. A ``few`` edges are
    joined in one task.
    """
    now = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    if now.count() <= few:
        return kept(now.repartition(1).mapInPandas(_joined, "node long, component long"))
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour is tied to the least of the node and its neighbours.
        near = _both_ways(now)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # Small star: every smaller neighbour, and the node, is tied to the least of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        now = kept(small)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tied = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return tied.union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
