"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    return F.when(norm(a) * norm(b) > 0, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))
