"""k-means: fitting by Spark, assignment and one step for given centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(point: Column, centres: list[list[float]]) -> Column:
    """Number of the nearest centre, of equally near ones the first."""
    rows = F.lit([[float(x) for x in c] for c in centres])

    def cost(centre: Column) -> Column:
        squares = F.zip_with(point, centre, lambda a, b: (a - b) * (a - b))
        return F.round(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d), 9)

    costs = F.transform(rows, cost)
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def lloyd_step(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """(cluster, pos, x, n): the means of the points nearest to each centre, by coordinate."""
    # The centre is found before the vector is taken apart, or it would be found for each part.
    assigned = df.select(nearest(F.col(vector), centres).alias("cluster"), F.col(vector).alias("v")).select("cluster", F.posexplode("v").alias("pos", "x"))
    return assigned.groupBy("cluster", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(key, cluster) of a k-means fit."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed).fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def with_place(r: Column, g: Column, b: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """Colour and place on one scale, for clusters that hang together."""
    return F.array(r, g, b, x / width * 255, y / height * 255)
