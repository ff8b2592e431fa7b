"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 for a zero vector, never below 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dot(a, b) / size))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def sum_of(v: Column, dim: int) -> list[Column]:
    """Aggregates that add vectors up; ``packed`` makes an array of them again."""
    return [F.sum(v[i]).alias(f"v{i}") for i in range(dim)]


def packed(dim: int) -> Column:
    return F.array(*(F.col(f"v{i}") for i in range(dim)))
