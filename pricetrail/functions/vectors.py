"""Vector comparison with array functions; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def cosine(left: Column, right: Column) -> Column:
    """Cosine in [-1, 1]; NULL for other sizes, values that are not finite and zero vectors."""
    dot = _sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))
    length = norm(left) * norm(right)
    usable = finite(left) & finite(right) & (F.size(left) == F.size(right))
    value = F.when(length > 0, dot / length)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
