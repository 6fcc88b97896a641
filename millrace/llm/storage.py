"""Cutting lineage where a result is read more than once or has run-dependent ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import checkpoint_folder


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder; later reads survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
