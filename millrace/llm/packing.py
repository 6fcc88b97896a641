"""Filling fixed-capacity containers with items.

Items are dealt by hash into groups of bounded size, each packed in one task by vector
best fit: items come largest first, every open container has residual tokens, places and
attention cost (the sum of the squares of its items), and of those that can take the item
under every constraint the one whose weighted residuals are left smallest is chosen (or, by
parameter, the one whose residuals point most in the item's direction). Groups are large
against a container, so that what they waste at their ends is less than one container in
thousands.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept

#: The folder of public tokenizers and the vocabulary used by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
#: Groups beyond this number share tasks, to spare the scheduler.
MOST_TASKS = 20_000

# Fixed value: how the byte-level vocabularies cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A byte-level tokenizer from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens) of whole texts; null texts count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "n_tokens": [len(encode(t)) if t else 0 for t in frame["t"]]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(count, f"k {kind}, n_tokens long")


def token_sizes(path: str) -> Callable[[str], np.ndarray]:
    """How many tokens end within each code point of a text, for splitting by tokens."""

    def sizes(text: str) -> np.ndarray:
        coder = tokenizer(path)
        ends = np.cumsum([len(b) for b in coder.decode_tokens_bytes(coder.encode_ordinary(text))], dtype=np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        char_ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        return np.bincount(np.searchsorted(char_ends, ends), minlength=len(codes))

    return sizes


def best_fit(
    sizes: np.ndarray, capacity: int, places: int, cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "norm"
) -> np.ndarray:
    """The container of each item; no container exceeds a capacity.

    Sizes must not exceed ``capacity``. An item whose square alone exceeds ``cost`` stands in a
    container of its own. Containers too full for the smallest item left are set aside, so that a
    step looks at open ones only.
    """
    order = np.argsort(-sizes, kind="stable")
    limits = np.array([capacity, places, cost], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    out = np.empty(len(sizes), dtype=np.int64)
    open_ids = np.empty(0, dtype=np.int64)
    left = np.empty((0, 3))
    made, least = 0, sizes.min() if len(sizes) else 0
    for step, i in enumerate(order):
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        fits = (left >= need).all(axis=1)
        if fits.any():
            rest = left / limits
            if rule == "dot":
                score = -(rest * (need / limits) * w).sum(axis=1)
            else:
                score = (((left - need) / limits) ** 2 * w).sum(axis=1)
            at = int(np.where(fits, score, np.inf).argmin())
        else:
            at = len(open_ids)
            open_ids = np.append(open_ids, made)
            left = np.vstack([left, limits])
            made += 1
        out[i] = open_ids[at]
        left[at] -= need
        if step % 64 == 63:
            usable = (left[:, 0] >= least) & (left[:, 1] >= 1) & (left[:, 2] >= float(least) ** 2)
            open_ids, left = open_ids[usable], left[usable]
    return out


def packed(
    items: DataFrame,
    key: str,
    size: str,
    capacity: int = CAPACITY,
    places: int = 256,
    cost: int | None = None,
    group_items: int = 4000,
    rule: str = "norm",
) -> DataFrame:
    """(key, part_no, n_tokens, container_id, unused): where every item goes.

    An item larger than ``capacity`` is cut into full parts, each a container of its own, and
    a rest that is packed like an item. Containers hold at most ``places`` items and ``cost``
    squares (by default no fewer than their tokens allow); an item whose square alone is more
    stands by itself, since only the capacity may split one. Items of size zero or null take a place
    only. ``unused`` is what the container has left. Repeated keys are items of their own. Empty
    input gives an empty result.
    """
    cost = cost if cost is not None else capacity * capacity
    kind = items.schema[key].dataType.simpleString()
    # Sizes are counted once, however dear the counting.
    sized = kept(items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    full = F.floor((F.col("n") - 1) / capacity).cast("int")
    parts = sized.withColumn("full", F.greatest(full, F.lit(0))).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("full"))))
    parts = parts.withColumn("n", F.when(F.col("part_no") < F.col("full"), F.lit(capacity)).otherwise(F.col("n") - F.col("full") * capacity))
    groups = max(1, -(-sized.count() // group_items))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("k", "part_no"), F.lit(groups)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "k", "part_no"], ascending=[False, True, True], na_position="last")
        where = best_fit(frame["n"].to_numpy(), capacity, places, cost, rule=rule)
        used = np.bincount(where, weights=frame["n"].to_numpy()).astype(np.int64)
        return pd.DataFrame(
            {
                "k": frame["k"].array,
                "part_no": frame["part_no"].array,
                "n_tokens": frame["n"].array,
                "container_id": (frame["g"].to_numpy() << 32) + where,
                "unused": capacity - used[where],
            }
        )

    # A number of partitions that is asked for stays, so that groups are packed side by side.
    out = dealt.select("k", "part_no", "n", "g").repartition(min(groups, MOST_TASKS), "g").groupBy("g").applyInPandas(pack, f"k {kind}, part_no int, n_tokens long, container_id long, unused long")
    return out.withColumnRenamed("k", key)


def space(assigned: DataFrame, capacity: int = CAPACITY, places: int = 256, cost: int | None = None) -> DataFrame:
    """One row: parts, containers, tokens, unused tokens, the share that is used, and the
    containers that tokens, places and cost would need at least, each taken alone."""
    cost = cost if cost is not None else capacity * capacity
    square = F.col("n_tokens") * F.col("n_tokens")
    # What stands alone for its cost needs one container.
    alone = F.count(F.when(square >= cost, 1))
    rest = F.coalesce(F.sum(F.when(square < cost, square)), F.lit(0))
    per = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), alone.alias("alone"), rest.alias("rest"))
    return per.agg(
        F.sum("parts").alias("n_parts"),
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        (F.count("*") * capacity - F.sum("n")).alias("n_unused"),
        F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("used_share"),
        F.ceil(F.sum("n") / capacity).alias("least_by_tokens"),
        F.ceil(F.sum("parts") / places).alias("least_by_places"),
        (F.sum("alone") + F.ceil(F.sum("rest") / cost)).alias("least_by_cost"),
    )
