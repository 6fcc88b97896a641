"""Incremental work: what is new is processed once and appended, whatever fails between.

A run reads the files that its checkpoint does not know, drops keys that its state knows,
works on the rest and appends it; a repeated micro-batch overwrites its own part. The sink is
read once at most: by the first batch of a checkpoint that finds one there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import remaining


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str], files_per_batch: int = 50) -> None:
    """Processes all new files of a folder in batches and ends."""

    def batch(df: DataFrame, number: int) -> None:
        todo = df
        if number == 0 and _exists(spark, sink):
            done = spark.read.parquet(sink).filter(F.col("batch_no") > 0)
            todo = remaining(todo, done, keys)
        work(todo).write.mode("overwrite").parquet(f"{sink}/batch_no={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).dropDuplicates(keys)
    query: StreamingQuery = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and key; works on streams and tables alike."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
