"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def is_finite(v: Column, dimension: int) -> Column:
    return (F.size(v) == dimension) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-7) -> Column:
    """Equal within a tolerance, element by element."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.greatest(relative * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)
