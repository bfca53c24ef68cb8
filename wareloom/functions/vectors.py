"""Vector expressions on ``array<double>``; rounding to 6 decimals comes before any ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(col: Column) -> Column:
    return F.sqrt(dot(col, col))


def normalise(col: Column) -> Column:
    """Unit length; a zero vector gives null values."""
    size = norm(col)
    return F.transform(col, lambda x: F.try_divide(x, size))


def usable(col: Column, dim: int) -> Column:
    """Right length, all finite, not all zero; null counts as not usable."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) == dim) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def is_unit(col: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce(F.abs(norm(col) - 1) <= tolerance, F.lit(False))


def fuse(parts: list[Column], weights: list[float]) -> Column:
    """Weighted sum of unit vectors, brought to unit length again."""
    if len(parts) != len(weights) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight a part, none negative, not all zero")

    def scale(part: Column, weight: float) -> Column:
        return F.transform(part, lambda x: x * F.lit(float(weight)))

    scaled = [scale(p, w) for p, w in zip(parts, weights)]
    return normalise(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled))


def difference_bits(col: Column, bits: int = 63) -> Column:
    """A hash whose bit i tells whether value i exceeds value i + 1."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)),
        F.lit(0).cast("long"),
        lambda acc, i: acc * 2 + F.when(F.element_at(col, i) > F.element_at(col, i + 1), 1).otherwise(0).cast("long"),
    )
