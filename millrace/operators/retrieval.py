"""Exact vector search, lookups, resumable work and leakage by fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prefix, strip
from ..session import checkpoint_folder

#: Query vectors that go to the executors at once; larger sets are searched in passes.
PASS_BYTES = 64 << 20


def _passes(queries: DataFrame, key: str, vector: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys: list = []
    rows: list = []
    size = 0
    for key_value, values in queries.select(key, vector).toLocalIterator():
        if values is None:
            continue
        keys.append(key_value)
        rows.append(np.asarray(values, dtype=np.float64))
        size += 8 * len(values)
        if size >= most:
            yield np.array(keys), np.vstack(rows)
            keys, rows, size = [], [], 0
    if keys:
        yield np.array(keys), np.vstack(rows)


def top_k(
    corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 3, metric: str = "ip", exclude_self: bool = False, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of the corpus for every query.

    Each corpus batch meets a block of queries in one matrix product; a task keeps its best k
    so far and gives them at its end, so k rows per query and task are shuffled. ``metric`` is the
    inner product ("ip", descending) or the squared distance ("l2", ascending). Equal scores go by
    the lesser key. A corpus of fewer than k rows gives fewer rows; null vectors never match.

    The driver and the executors hold ``pass_bytes`` of query vectors at a time: with more, the
    findings of a pass are written down before the next one, which reads the corpus again.
    """
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    schema = f"query_id {queries.schema[key].dataType.simpleString()}, {key} {kind}, score double"
    slim = corpus.select(F.col(key), F.col(vector).alias("v")).filter("v is not null")
    sign = -1.0 if metric == "ip" else 1.0

    def searched(sent) -> DataFrame:
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            best = pd.DataFrame({"q": np.empty(0, dtype=np.int64), "cost": np.empty(0), "key": []})
            for frame in frames:
                if not len(frame):
                    continue
                keys = frame[key].to_numpy()
                vectors = np.vstack(frame["v"].to_numpy()).astype(np.float64)
                found = [best]
                for lo in range(0, len(ids), 512):
                    block = matrix[lo : lo + 512]
                    if metric == "ip":
                        cost = -(block @ vectors.T)
                    else:
                        cost = (block**2).sum(1)[:, None] - 2 * block @ vectors.T + (vectors**2).sum(1)[None, :]
                    if exclude_self:
                        cost = np.where(ids[lo : lo + 512, None] == keys[None, :], np.inf, cost)
                    # Rounding keeps equal scores equal whichever batch they were computed in.
                    cost = np.round(cost, 9)
                    n = min(k, len(keys))
                    edge = np.partition(cost, n - 1, axis=1)[:, n - 1]
                    q, c = np.nonzero((cost <= edge[:, None]) & np.isfinite(cost))
                    found.append(pd.DataFrame({"q": lo + q, "cost": cost[q, c], "key": keys[c]}))
                every = pd.concat(found[len(best) == 0 :], ignore_index=True).sort_values(["q", "cost", "key"], kind="stable")
                best = every[every.groupby("q").cumcount() < k]
            yield pd.DataFrame({"query_id": ids[best["q"].to_numpy()], key: best["key"].to_numpy(), "score": sign * best["cost"].to_numpy()})

        return slim.mapInPandas(search, schema)

    portions = _passes(queries, key, vector, pass_bytes)
    portion, following = next(portions, None), next(portions, None)
    found = None
    while following is not None:
        checkpoint_folder(spark)
        sent = spark.sparkContext.broadcast(portion)
        part = searched(sent).checkpoint(eager=True)
        sent.destroy()
        found = part if found is None else found.unionByName(part)
        portion, following = following, next(portions, None)
    if portion is None:
        found = spark.createDataFrame([], schema)
    else:
        last = searched(spark.sparkContext.broadcast(portion))
        found = last if found is None else found.unionByName(last)
    order = [F.col("score").desc() if metric == "ip" else F.col("score").asc(), F.col(key)]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def contexts(hits: DataFrame, texts: DataFrame, key: str, text: str, cut: int | None = 1500) -> DataFrame:
    """(query_id, context): the texts of the hits in rank order, joined and cut."""
    parts = F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")
    return hits.join(texts.select(key, text), key).groupBy("query_id").agg((prefix(joined, cut) if cut else joined).alias("context"))


def knn_labels(hits: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query_id, predicted): the commonest label of the hits, of equals the least."""
    votes = hits.join(labels.select(key, label), key).groupBy("query_id", label).agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).alias("predicted"))


def grid(records: DataFrame, *axes: tuple[str, list[str]]) -> DataFrame:
    """Every record under every combination of the axes' values; no join is needed."""
    out = records
    for name, values in axes:
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def done_groups(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Groups in which every required metric has a value."""
    agg = results.groupBy(*keys).agg(*[F.count(m).alias(f"_{m}") for m in metrics])
    return agg.filter(" and ".join(f"`_{m}` > 0" for m in metrics)).select(*keys)


def lookup(df: DataFrame, on: Column, table: DataFrame, key: str, value: str, order: str, name: str, default: str = "") -> DataFrame:
    """A dictionary lookup: stripped keys, the last of equal ones wins, a miss gives the default."""
    words = table.select(strip(F.col(key)).alias("_k"), F.col(value).alias("_v"), F.col(order).alias("_o"))
    last = words.groupBy("_k").agg(F.max_by("_v", "_o").alias("_v"))
    return df.withColumn("_on", strip(on)).join(last, F.col("_on") == F.col("_k"), "left").withColumn(name, F.coalesce("_v", F.lit(default))).drop("_on", "_k", "_v")


def updated(base: DataFrame, news: DataFrame, keys: list[str], columns: list[str], where: Column) -> DataFrame:
    """Base rows with the new values of ``columns`` where the condition holds and there are any."""
    fresh = news.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(fresh, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(where, F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    return joined.select(*base.columns)


def fingerprint(c: Column, read: int = 100, keep: int = 60) -> Column:
    """The first characters of the stripped opening."""
    return prefix(strip(prefix(c, read)), keep)


def without_leaks(chunks: DataFrame, text: str, evaluation: DataFrame, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Chunks whose fingerprint equals none of the evaluation set's.

    ``fields`` maps a column to (read, least): values longer than ``least`` give a fingerprint
    of their first ``read`` characters.
    """
    prints = None
    for column, (count, least) in fields.items():
        part = evaluation.filter(F.length(column) > least).select(fingerprint(F.col(column), count).alias("_f"))
        prints = part if prints is None else prints.union(part)
    return chunks.withColumn("_f", fingerprint(F.col(text))).join(prints.distinct(), "_f", "left_anti").drop("_f")


def in_pairs(df: DataFrame, columns: list[str], pairs: list[tuple]) -> DataFrame:
    """Rows whose values in two or more columns are one of the given tuples."""
    wanted = df.sparkSession.createDataFrame(pairs, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns))
    return df.join(F.broadcast(wanted), columns, "left_semi")
