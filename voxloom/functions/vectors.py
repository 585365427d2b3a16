"""Distances and cosines, as expressions over columns and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist2(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance of two points given by their coordinates, summed left to right."""
    return reduce(lambda x, y: x + y, ((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when one is empty, zero, or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
