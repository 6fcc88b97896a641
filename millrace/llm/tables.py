"""Reading the test tables for the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest order, of equals the greatest values."""
    return (
        df.select(F.col(key), F.struct(F.col(order).alias("_t"), *columns).alias("_m"))
        .groupBy(key)
        .agg(F.max("_m").alias("_m"))
        .select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])
    )
