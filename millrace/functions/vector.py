"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def rescaled(score: Column, floor: float, ceiling: float) -> Column:
    """floor to 0, ceiling to 1, linear between and clamped."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - floor) / (ceiling - floor)))


def hashed_buckets(stems: Column, size: int = 512) -> Column:
    """The bucket of each stem: the first eight hexadecimal digits of its SHA-1, modulo size."""
    return F.transform(stems, lambda w: (F.conv(F.substring(F.sha1(w.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int"))
