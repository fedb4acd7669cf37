"""Vectors and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def vector_score(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """1 - distance: squared Euclidean, or cosine."""
    if metric == "l2sq":
        return 1 - l2sq(a, b)
    if metric == "cosine":
        return cosine(a, b)
    raise ValueError(f"metric {metric} is not l2sq or cosine")


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
