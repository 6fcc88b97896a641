"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner(v, v))


def l2_normalised(v: Column, epsilon: float = 1e-9) -> Column:
    """The vector over its length; the small constant keeps a null vector at zero."""
    length = norm(v) + epsilon
    return F.transform(v, lambda x: x / length)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(v: Column) -> Column:
    """Position of the first greatest value, from 0."""
    return F.array_position(v, F.array_max(v)) - 1
