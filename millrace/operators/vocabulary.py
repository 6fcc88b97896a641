"""Label vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def label_vocabulary(df: DataFrame, tags: str, extra: tuple[str, ...] = ("POS", "ADJ", "SUF"), first: tuple[str, ...] = ()) -> DataFrame:
    """(tag, tag_id): the distinct labels of space-separated tags in order, fixed ones before
    and after. Numbers come from counts by the first letters, so that no task sees all labels."""
    spark = df.sparkSession
    found = df.select(F.explode(F.split(F.trim(tags), r"\s+")).alias("tag")).filter("tag <> ''").distinct().withColumn("part", F.lit(1))
    fixed = [(t, p, i) for p, group in ((0, first), (2, extra)) for i, t in enumerate(group)]
    added = spark.createDataFrame(fixed, "tag string, part int, at int")
    new = found.join(F.broadcast(added), "tag", "left_anti").withColumn("at", F.lit(0)).unionByName(added)
    # One text that orders like (part, at, tag); its beginning is the bucket.
    placed = new.withColumn("_o", F.concat(F.col("part").cast("string"), F.lpad(F.col("at").cast("string"), 9, "0"), "tag"))
    return numbered(placed, [], "_o", F.substring("_o", 1, 12)).select("tag", (F.col("pos") - 1).cast("int").alias("tag_id"))
