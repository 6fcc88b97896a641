"""Answer-quality metrics, null-aware summaries and classification scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(c: str | Column) -> Column:
    """The value, or null where it is not a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def group_means(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means over values rounded first, as the reports do, and rounded again."""
    return df.groupBy(*keys).agg(*[F.round(F.avg(F.round(present(m), digits)), digits).alias(m) for m in metrics])


def present_means(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 4, only_with_values: bool = False) -> DataFrame:
    """Means of the values that are there, with the number of rows; a group without any
    value of a metric has null, and with ``only_with_values`` a group without any value
    of any metric is left out."""
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(present(m)), digits).alias(m) for m in metrics],
    )
    return agg.filter(" or ".join(f"{m} is not null" for m in metrics)) if only_with_values else agg


def null_rates(df: DataFrame, metrics: list[str], limit: float = 0.1) -> DataFrame:
    """(metric, null_rate, flagged) for every metric."""
    rates = df.agg(*[F.avg(present(m).isNull().cast("double")).alias(m) for m in metrics])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 6).alias("null_rate")) for m in metrics])
    return rates.select(F.inline(cells)).withColumn("flagged", F.col("null_rate") > limit)


def pivot_delta(df: DataFrame, rows: str, columns: str, metric: str, plus: str, minus: str, domain: list[str], digits: int = 4) -> DataFrame:
    """Means by row and column value, with the difference of two of the columns."""
    means = df.groupBy(rows).pivot(columns, domain).agg(F.round(F.avg(present(metric)), digits))
    return means.withColumn("delta", F.round(F.col(plus) - F.col(minus), digits))


def weighted_scores(df: DataFrame, truth: str, predicted: str, labels: list, digits: int = 6) -> DataFrame:
    """Accuracy over all rows; precision, recall and F1 of the labels weighted by support."""

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1)).cast("double")

    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        F.avg((t == p).cast("double")).alias("accuracy"),
        *[x for i, lab in enumerate(labels) for x in (n(t == lab).alias(f"s{i}"), n((t == lab) & (p == lab)).alias(f"t{i}"), n(p == lab).alias(f"p{i}"))],
    )
    total = sum((F.col(f"s{i}") for i in range(len(labels))), F.lit(0.0))

    def scores(i: int) -> tuple[Column, Column, Column]:
        pr = F.when(F.col(f"p{i}") > 0, F.col(f"t{i}") / F.col(f"p{i}")).otherwise(0.0)
        re = F.when(F.col(f"s{i}") > 0, F.col(f"t{i}") / F.col(f"s{i}")).otherwise(0.0)
        return pr, re, F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)

    def weighted(which: int) -> Column:
        return F.round(sum((scores(i)[which] * F.col(f"s{i}") for i in range(len(labels))), F.lit(0.0)) / total, digits)

    return counts.select(
        F.round("accuracy", digits).alias("accuracy"),
        weighted(0).alias("weighted_precision"),
        weighted(1).alias("weighted_recall"),
        weighted(2).alias("weighted_f1"),
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def rouge_l(pred: Column, gold: Column, pattern: str = r"[a-z0-9]+", digits: int = 4) -> Column:
    """F-measure of the longest common subsequence of lower-case tokens, for texts of any length."""
    import re

    find = re.compile(pattern).findall

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for said, wanted in parts:
            out = []
            for p, g in zip(said, wanted, strict=True):
                a, b = find((g or "").lower()), find((p or "").lower())
                n = lcs_length(a, b) if a and b else 0
                out.append(2 * n / (len(a) + len(b)) if n else 0.0)
            yield pd.Series(out)

    return F.round(score(pred, gold), digits)


def rouge_l_short(pred: Column, gold: Column, pattern: str = r"[a-z0-9]+", digits: int = 4) -> Column:
    """The same within Catalyst, by a fold over token rows; for short texts."""
    a = F.regexp_extract_all(F.lower(F.coalesce(gold, F.lit(""))), F.lit(pattern), F.lit(0))
    b = F.regexp_extract_all(F.lower(F.coalesce(pred, F.lit(""))), F.lit(pattern), F.lit(0))
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, word: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, diagonal = F.get(row, j), F.get(row, j - 1)
            value = F.when(F.get(b, j - 1) == word, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        steps = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    n = F.element_at(F.aggregate(a, zero, next_row), -1)
    return F.when(F.size(a) + F.size(b) > 0, F.round(2.0 * n / (F.size(a) + F.size(b)), digits)).otherwise(F.lit(0.0))


def overlap_proxies(df: DataFrame, answer: str, context: str, question: str, gold: str, pattern: str = r"[가-힣]{2,}|[A-Za-z]{2,}|\d+") -> DataFrame:
    """Deterministic stand-ins for judged scores: token shares, not the judged metrics.

    The token sets are columns of their own, so that each text is read once.
    """

    def words(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(pattern), F.lit(0)))

    def share(of: str, within: str) -> Column:
        both = F.size(F.array_intersect(of, within))
        return F.when(F.size(of) > 0, F.round(both / F.size(of), 4))

    sets = df.withColumns({"_a": words(answer), "_c": words(context), "_q": words(question), "_g": words(gold)})
    scores = {
        "faithfulness_proxy": share("_a", "_c"),
        "answer_relevancy_proxy": share("_q", "_a"),
        "context_recall_proxy": share("_g", "_c"),
        "context_precision_proxy": share("_c", "_g"),
    }
    return sets.withColumns(scores).drop("_a", "_c", "_q", "_g")
