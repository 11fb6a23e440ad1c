"""Vector functions on array columns, in double, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """The largest double where there is no cosine."""
    return F.coalesce(1 - cosine(a, b), F.lit(1.7976931348623157e308))


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(as_double(a), lambda x: x / norm(a))).otherwise(as_double(a))
