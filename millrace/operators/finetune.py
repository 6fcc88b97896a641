"""Preparing chat data: message arrays, prompts, stable splits and samples, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import by_hash, numbered


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """A three-message array."""
    roles = (("system", system), ("user", user), ("assistant", assistant))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in roles])


def first_by_role(messages: Column, role: str) -> Column:
    """The first message of a role, or empty text; roles match in any letter case."""
    mine = F.filter(messages, lambda m: F.lower(m["role"]) == role)
    return F.coalesce(F.get(mine, F.lit(0))["content"], F.lit(""))


def rendered(messages: Column) -> Column:
    """One line per message, role first."""
    lines = F.transform(messages, lambda m: F.concat(F.lower(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return F.array_join(lines, "\n")


def without_system(messages: Column, user: Column) -> Column:
    """The user text replaced by a prompt; of the others the assistant's is kept."""
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), first_by_role(messages, "assistant").alias("content")),
    )


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and the seed; 32 bits of the hash."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_by_hash(key: Column, seed: int = 42, held_out: float = 0.05) -> Column:
    """'valid' for the held-out share, else 'train'; the same for a key in any run and layout."""
    return F.when(uniform(key, seed) < held_out, "valid").otherwise("train")


def weighted_choice(key: Column, weights: dict[str, float], seed: int = 42) -> Column:
    """One of the names, with probabilities in proportion to their weights."""
    total, below = sum(weights.values()), 0.0
    u = uniform(key, seed)
    names = list(weights)
    choice = None
    for name in names[:-1]:
        below += weights[name] / total
        choice = F.when(u < below, name) if choice is None else choice.when(u < below, name)
    return F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])


def permuted(df: DataFrame, key: str, seed: int = 42, name: str = "place") -> DataFrame:
    """Every row with its place in a random order that keys and seed determine."""
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn("_all", F.lit(1))
    return numbered(hashed, ["_all"], "_h", by_hash("_h"), name).drop("_h", "_all")


def leading_share(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """A column ``part``: 'train' for the leading share of the permutation, else 'test'."""
    n = df.count()
    return permuted(df, key, seed).withColumn("part", F.when(F.col("place") <= F.floor(F.lit(share * n)), "train").otherwise("test"))
