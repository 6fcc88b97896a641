"""Spreading rows where a table's files would leave most of the cluster idle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in so few partitions that half of them or more
    would wait; otherwise the same frame. For work that costs far more than moving its rows.
    Large tables come in enough partitions and are never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
