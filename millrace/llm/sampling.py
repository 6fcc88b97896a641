"""Sample matching target category proportions.

One pass keeps, for each cell of labels, a reservoir of the records with the least
hashes: the least k of a union are the least k of the parts' least k, so reservoirs
merge. Spark keeps them by counting hash ranges before the shuffle and ranking within one
range, so that no cell has to fit into a task. After the final counts the places of each
plan are dealt out to its categories, minimums first, then targets, then what is left;
each reservoir is trimmed to its quota, and the report on categories that fall short,
with the cause, is made from the records drawn.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import kept

ANY = "*"


@F.pandas_udf(T.StringType())
def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        known: dict = {}
        yield part.map(lambda x: None if x is None else known.setdefault(x, unicodedata.normalize("NFC", x)))


def label(column: Column) -> Column:
    """A label in NFC, without what follows its first underscore and without white space."""
    return F.regexp_replace(F.substring_index(_composed(column), "_", 1), r"(?U)[\s\x{1c}-\x{1f}]+", "")


def labelled(records: DataFrame, key: str, labels: list[str], order: str) -> DataFrame:
    """One row per key, its latest delivery, with labels made equal. Null keys are no records."""
    last = (
        records.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.struct(F.col(order).alias("_t"), *labels).alias("m"))
        .groupBy("key")
        .agg(F.max("m").alias("m"))
    )
    return last.select("key", *[label(F.col(f"m.{x}")).alias(f"l{i}") for i, x in enumerate(labels)])


def _none(column: str) -> Column:
    return F.greatest(F.coalesce(F.col(column), F.lit(0)), F.lit(0))


def _targets(plans: DataFrame, plan: str, labels: list[str], share: str, least: str, size: str) -> DataFrame:
    """Plan categories with equal labels, beside the labels as given. Null shares, minimums and sizes count as 0."""
    return plans.select(
        F.col(plan).alias("plan"),
        *[F.col(x).alias(f"g{i}") for i, x in enumerate(labels)],
        *[F.when(F.col(x) == ANY, F.lit(ANY)).otherwise(label(F.col(x))).alias(f"l{i}") for i, x in enumerate(labels)],
        F.greatest(_none(least), F.floor(_none(size) * _none(share) + F.lit(0.5))).cast("bigint").alias("want"),
        _none(least).cast("bigint").alias("floor"),
        _none(size).cast("bigint").alias("size"),
        _none(share).cast("double").alias("share"),
    )


def _covered(plans: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Each plan category beside the cells that it covers.

    A category names for each label a value or any; it meets a cell by an equi-join on
    the labels it names, once for each pattern of named labels.
    """
    out = None
    for named in range(2**n):
        on = [i for i in range(n) if named >> i & 1]
        part = plans.filter(
            " and ".join([f"l{i} {'<>' if i in on else '='} '{ANY}'" for i in range(n)]) or "true"
        ).drop(*[f"l{i}" for i in range(n) if i not in on])
        meets = part.join(cells, [f"l{i}" for i in on]) if on else part.join(cells.withColumn("_all", F.lit(1)), F.col("_all") == 1).drop("_all")
        meets = meets.select("plan", *[f"g{i}" for i in range(n)], "want", "floor", "size", "share", *[c for c in cells.columns if not c.startswith("l")])
        out = meets if out is None else out.unionByName(meets)
    return out


def _priority(column: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def least_hashes(df: DataFrame, groups: list[str], limit: str, rank_as: str | None = None) -> DataFrame:
    """The rows of each group with the ``limit`` least (h, key), with their ranks if named.

    Hashes fall into 4,096 ranges. Counts by range, which merge like the reservoirs they
    describe, tell how many rows lie in lower ranges, so that ranks are needed within one
    range only and a group of any size is spread over many tasks.
    """
    ranged = df.withColumn("_range", F.substring("h", 1, 3))
    below = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_c")).withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0))).drop("_c")
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in [*groups, "_range"]]
    near = ranged.alias("l").join(counts.alias("r"), on).select("l.*", "_below").filter(F.col("_below") < F.col(limit))
    rank = Window.partitionBy(*groups, "_range").orderBy("h", "key")
    ranked = near.withColumn("_rank", F.col("_below") + F.row_number().over(rank)).filter(F.col("_rank") <= F.col(limit)).drop("_range", "_below")
    return ranked.withColumnRenamed("_rank", rank_as) if rank_as else ranked.drop("_rank")


def reservoirs(records: DataFrame, largest: int, n: int, seed: int, rank_as: str | None = None) -> DataFrame:
    """The ``largest`` records of each cell with the least hashes."""
    hashed = records.withColumn("h", _priority(F.col("key"), seed)).withColumn("_most", F.lit(largest))
    return least_hashes(hashed, [f"l{i}" for i in range(n)], "_most", rank_as).drop("_most")


def apportioned(weights: np.ndarray, rooms: np.ndarray, places: int) -> np.ndarray:
    """How many of the places each claimant gets, at most its room, in proportion to its weight.

    A claimant's k-th place is called at (k - 1/2) / weight; places go to the earliest
    calls, of equal ones to the first claimant. All places go as long as there is room. The
    last call that is served is found by bisection, so the number of places costs nothing.
    """
    weights, rooms = np.maximum(np.asarray(weights, dtype=float), 1e-9), np.asarray(rooms, dtype=np.int64)
    places = min(int(places), int(rooms.sum()))
    if places <= 0:
        return np.zeros(len(rooms), dtype=np.int64)

    def called(t: float) -> np.ndarray:
        return np.minimum(rooms, np.floor(np.minimum(t * weights, rooms) + 0.5).astype(np.int64))

    low, high = 0.0, 2.0 * (float(rooms.max()) + 1) / float(weights.min())
    for _ in range(200):
        mid = (low + high) / 2
        if called(mid).sum() < places:
            low = mid
        else:
            high = mid
    # What lies within rounding of the last call counts as equal to it.
    got, late = called(high * (1 - 1e-12)), called(high * (1 + 1e-12))
    while (left := places - int(got.sum())) > 0:
        got[np.flatnonzero(late > got)[:left]] += 1
    return got


class _Dealing:
    """The records of the cells of one plan, dealt out to the categories that cover them."""

    def __init__(self, covers: dict[tuple, list[str]], there: dict[str, int]) -> None:
        self.covers, self.spare = covers, dict(there)
        self.holders: dict[str, list[tuple]] = {}
        for c, cells in covers.items():
            for cell in cells:
                self.holders.setdefault(cell, []).append(c)
        self.given = {(c, cell): 0 for c, cells in covers.items() for cell in cells}
        self.got = dict.fromkeys(covers, 0)

    def _handed_over(self, c: tuple, want: int) -> int:
        """Up to want more records for c: along the shortest path of categories that hand
        over a record of a cell of theirs and take one of another, to a cell with spare ones."""
        came: dict[tuple, tuple | None] = {c: None}
        queue = [c]
        for at in queue:
            for cell in self.covers[at]:
                if self.spare[cell] > 0:
                    steps, node, n = [(at, cell)], at, min(want, self.spare[cell])
                    while came[node] is not None:
                        before, through = came[node]
                        n = min(n, self.given[node, through])
                        steps.append((before, through))
                        node = before
                    self.spare[cell] -= n
                    for (to, x), (before, through) in zip(steps, steps[1:]):  # noqa: B905
                        self.given[to, x] += n
                        self.given[to, through] -= n
                    self.given[steps[-1]] += n
                    return n
                for other in self.holders[cell]:
                    if other not in came and self.given[other, cell] > 0:
                        came[other] = (at, cell)
                        queue.append(other)
        return 0

    def give(self, c: tuple, want: int) -> int:
        """Gives c up to want more records, from its cells in proportion to what is there."""
        cells, left = self.covers[c], int(want)
        spare = np.array([self.spare[x] for x in cells], dtype=np.int64)
        for cell, n in zip(cells, apportioned(spare, spare, left).tolist(), strict=True):
            self.spare[cell] -= n
            self.given[c, cell] += n
            left -= n
        while left > 0 and (n := self._handed_over(c, left)):
            left -= n
        self.got[c] += int(want) - left
        return int(want) - left


def allotted(plan: pd.DataFrame, groups: list[str]) -> pd.DataFrame:
    """How many records of each cell go to each category of one plan.

    Takes (plan, g*, cell, there, want, floor, size, share), a row for each category and
    cell that it covers, and one with a null cell for a category that covers none. Gives
    (plan, g*, cell, start, n): the category gets n records of the cell after the first
    start. Minimums are served first, then targets, then what is left of the sample goes to
    whoever has records, in proportion to the shares. Each step ends when the sample is full
    or nobody can take more, so no place stays empty that could be filled and the sample
    never exceeds its size; where minimums or targets sum to more, they are cut in proportion.
    """
    rows = plan.sort_values([*groups, "cell"], na_position="first").drop_duplicates([*groups, "cell"])
    names = [tuple(x) for x in rows[groups].itertuples(index=False)]
    known = dict(zip(names, rows.to_dict("records"), strict=True))
    covers: dict[tuple, list[str]] = {c: [] for c in known}
    there: dict[str, int] = {}
    for c, cell, n in zip(names, rows["cell"], rows["there"], strict=True):
        if isinstance(cell, str):
            covers[c].append(cell)
            there[cell] = int(n)
    dealing = _Dealing(covers, there)
    left = int(rows["size"].max())
    for aim in ("floor", "want", None):
        open_ones = list(covers)
        while left > 0 and open_ones:
            rooms = np.array([left if aim is None else max(0, int(known[c][aim]) - dealing.got[c]) for c in open_ones], dtype=np.int64)
            rooms = np.minimum(rooms, [sum(there[x] for x in covers[c]) - dealing.got[c] for c in open_ones])
            parts = apportioned(rooms if aim else [known[c]["share"] for c in open_ones], rooms, left)
            if not parts.any():
                break
            still = []
            for c, part in zip(open_ones, parts.tolist(), strict=True):
                n = dealing.give(c, part)
                left -= n
                if n == part:
                    still.append(c)
            open_ones = still
    out, start = [], dict.fromkeys(there, 0)
    for (c, cell), n in dealing.given.items():
        if n:
            out.append((rows["plan"].iloc[0], *c, cell, start[cell], n))
            start[cell] += n
    return pd.DataFrame(out, columns=["plan", *groups, "cell", "start", "n"])


def _drawn(records: DataFrame, plans: DataFrame, key: str, labels: list[str], order: str, plan: str, share: str, least: str, size: str, seed: int):
    """The targets, what is there of each, and the records drawn as (plan, g*, key)."""
    n = len(labels)
    latest = kept(labelled(records, key, labels, order))
    targets = kept(_targets(plans, plan, labels, share, least, size).distinct())
    groups = [f"g{i}" for i in range(n)]
    cell = F.to_json(F.array(*[f"l{i}" for i in range(n)])).alias("cell")
    cells = latest.groupBy(*[f"l{i}" for i in range(n)]).agg(F.count("*").alias("there")).select("*", cell)
    aims = targets.groupBy("plan", *groups, *[f"l{i}" for i in range(n)]).agg(*[F.max(c).alias(c) for c in ("want", "floor", "size", "share")])
    covered = kept(_covered(aims, cells, n))
    wide = [F.col("t." + c).eqNullSafe(F.col("c." + c)) for c in ["plan", *groups]]
    asked = aims.alias("t").join(covered.select("plan", *groups, "cell", "there").alias("c"), wide, "left")
    asked = asked.select(*[f"t.{c}" for c in ["plan", *groups, "want", "floor", "size", "share"]], "cell", "there")
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ["plan", *groups, "cell"]) + ", start long, n long"
    parts = kept(asked.groupBy("plan").applyInPandas(lambda p: allotted(p, groups), schema))

    largest = int(aims.agg(F.max("size")).first()[0] or 0)
    # Where the categories of a plan share no cell, each has the least hashes of all its records.
    shared = covered.groupBy("plan", "cell").count().filter("count > 1").select("plan").distinct()
    quota = parts.join(shared, "plan", "left_anti").groupBy("plan", *groups).agg(F.sum("n").alias("quota"))
    lowest = kept(reservoirs(latest, largest, n, seed, "place").select("*", cell))
    met = _covered(aims, lowest, n)
    whole = least_hashes(met.join(quota, ["plan", *groups]), ["plan", *groups], "quota")
    pieces = met.join(parts.join(shared, "plan", "left_semi"), ["plan", *groups, "cell"]).filter("place > start and place <= start + n")
    drawn = whole.select("plan", *groups, "key").union(pieces.select("plan", *groups, "key").distinct())
    return targets, covered, drawn


def matched_sample(
    records: DataFrame, plans: DataFrame, key: str, labels: list[str], order: str, plan: str, share: str, least: str, size: str, seed: int = 42
) -> DataFrame:
    """(plan, labels of the category, key): the sampled records of every plan.

    A record is drawn at most once in a plan even where its categories overlap; then the
    records of each cell are dealt out among the categories that cover it. A sample has its
    full size if the categories of the plan have as many records, and is never larger. The draw
    depends on keys and seed alone, not on partitions. Null keys are no records, a null label
    counts for any only; no records or no plans give an empty result.
    """
    _, _, drawn = _drawn(records, plans, key, labels, order, plan, share, least, size, seed)
    names = zip([f"g{i}" for i in range(len(labels))], labels, strict=True)
    return drawn.select(F.col("plan").alias(plan), *[F.col(g).alias(x) for g, x in names], F.col("key").alias(key))


def shortfalls(
    records: DataFrame, plans: DataFrame, key: str, labels: list[str], order: str, plan: str, share: str, least: str, size: str, seed: int = 42
) -> DataFrame:
    """Every category of every plan beside the sample drawn for it.

    Columns: plan, the labels as the plan gives them, n_wanted (the target, or the minimum if
    that is more), n_there, n_drawn, n_missing (what is there less than wanted), and the cause
    if fewer are drawn than wanted: ``supply`` (so many are not there), ``minimums`` (the
    minimums of the plan sum to more than the sample holds), ``trimmed`` (its targets do), or
    ``shared`` (other categories needed the same records). Categories that come more than once
    come out once for each target. No records leave all categories short; no plans give an
    empty result.
    """
    n = len(labels)
    targets, covered, drawn = _drawn(records, plans, key, labels, order, plan, share, least, size, seed)
    groups = ["plan", *[f"g{i}" for i in range(n)]]
    there = covered.groupBy(*groups).agg(F.sum("there").alias("there"))
    counted = drawn.groupBy(*groups).agg(F.count("*").alias("drawn"))
    p = Window.partitionBy("plan")
    report = targets.join(there, groups, "left").join(counted, groups, "left").na.fill(0, ["there", "drawn"])
    report = report.withColumn("_least", F.sum("floor").over(p)).withColumn("_all", F.sum("want").over(p))
    cause = (
        F.when(F.col("there") < F.col("want"), "supply")
        .when(F.col("drawn") >= F.col("want"), None)
        .when((F.col("drawn") < F.col("floor")) & (F.col("_least") > F.col("size")), "minimums")
        .when(F.col("_all") > F.col("size"), "trimmed")
        .otherwise("shared")
    )
    return report.select(
        F.col("plan").alias(plan),
        *[F.col(f"g{i}").alias(x) for i, x in enumerate(labels)],
        F.col("want").alias("n_wanted"),
        F.col("there").cast("bigint").alias("n_there"),
        F.col("drawn").cast("bigint").alias("n_drawn"),
        F.greatest(F.col("want") - F.col("there"), F.lit(0)).cast("bigint").alias("n_missing"),
        cause.alias("cause"),
    ).distinct()
