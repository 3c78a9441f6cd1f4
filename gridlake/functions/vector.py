"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(as_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when a side is missing, empty or all zeros."""
    scale = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(as_doubles(a), lambda x: x / length)).otherwise(as_doubles(a))
