"""Array arithmetic that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 where a norm is zero."""
    return F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 1 if both or either are constant and equal, else 0."""
    ma, mb = mean(a), mean(b)
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    scale = norm(da) * norm(db)
    return F.when(scale > 0, F.try_divide(dot(da, db), scale)).otherwise(F.when((norm(da) == 0) & (norm(db) == 0), 1.0).otherwise(0.0))


def histogram(a: Column, low: float, high: float, bins: int) -> Column:
    """Counts of ``bins`` equal bins; the upper bound is exclusive."""
    at = F.transform(F.filter(a, lambda x: (x >= low) & (x < high)), lambda x: F.floor((x - low) * bins / (high - low)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))


def min_max(a: Column, low: Column, high: Column) -> Column:
    """Rescaled to 0..1 between common bounds; degenerate ranges count as 1e-5."""
    span = F.greatest(high - low, F.lit(1e-5))
    return F.transform(a, lambda x: (x - low) / span)
