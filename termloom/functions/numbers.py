"""Numeric helpers that give the same digits on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def change(value: Column, base: Column) -> tuple[Column, Column]:
    """Percent and absolute change against a base; for a base that is not positive 0 and the value."""
    positive = base > 0
    return F.when(positive, (value - base) / base * 100.0).otherwise(F.lit(0.0)), F.when(positive, value - base).otherwise(value)


def fixed(c: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", c)


def describe(c: Column) -> list[Column]:
    """n, mean, median, min, max and sample deviation (0 for one row)."""
    return [
        F.count(c).alias("n"),
        rounded(F.avg(c)).alias("mean"),
        rounded(F.median(c)).alias("median"),
        rounded(F.min(c)).alias("min"),
        rounded(F.max(c)).alias("max"),
        rounded(F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias("stdev"),
    ]


def spread(c: Column) -> list[Column]:
    """Population variance, min, max and range."""
    return [rounded(F.var_pop(c), 9).alias("variance"), rounded(F.min(c)).alias("min"), rounded(F.max(c)).alias("max"), rounded(F.max(c) - F.min(c)).alias("range")]


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)] if n > 1 else [low]
