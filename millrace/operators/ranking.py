"""Row numbers and quotas that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, groups: list[str], order: str, bucket: Column, name: str = "pos") -> DataFrame:
    """Exact row numbers from 1 by ``order`` within ``groups``.

    ``bucket`` must not fall where ``order`` rises. Rows are ranked within a bucket; a
    running sum of the bucket counts, one row per group and bucket, gives what lies before.
    A group of any size so spreads over as many tasks as it has buckets. Equal orders get
    an arbitrary order: pass a unique one.
    """
    tagged = df.withColumn("_b", bucket)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        tagged.groupBy(*groups, "_b")
        .agg(F.count("*").alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c")
    )
    within = Window.partitionBy(*groups, "_b").orderBy(order)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*groups, "_b"]]
    joined = tagged.alias("l").join(counts.alias("r"), on).select("l.*", "r._before")
    return joined.withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_b", "_before")


def by_id(column: str, width: int = 4096) -> Column:
    """Buckets for whole-number ids."""
    return F.floor(F.col(column) / width)


def by_hash(column: str) -> Column:
    """Buckets for hexadecimal hashes."""
    return F.substring(column, 1, 3)


def first_n(df: DataFrame, groups: list[str], order: list[str], n: int | Column) -> DataFrame:
    """The first n rows of each group; Spark limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("pos", rank).filter(F.col("pos") <= n)


def priority_quota(df: DataFrame, category: str, priorities: list[str], order: str, target: int) -> DataFrame:
    """Up to ``target`` rows, taken from the categories in the order of their priority.

    Each category is cut to the target first, so the final ranking sees at most one target
    of rows per category of the list. Categories not listed give nothing.
    """
    rank = F.array_position(F.lit(priorities), F.col(category))
    listed = df.withColumn("_p", rank).filter("_p > 0")
    capped = first_n(listed, ["_p"], [order], target).drop("pos")
    return capped.orderBy("_p", order).limit(target).withColumn("pos", F.row_number().over(Window.orderBy("_p", order))).drop("_p")


def percentages(df: DataFrame, category: str, domain: list[str], digits: int = 2) -> DataFrame:
    """(category, n, pct) over a fixed domain; categories without rows are kept with 0."""
    spark = df.sparkSession
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(d,) for d in domain], f"{category} string")
    joined = F.broadcast(fixed).join(counts, category, "left").select(category, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return joined.withColumn("pct", F.round(F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0), digits))
