"""Vector and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(EPS)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def adaptive_threshold(q75: Column, low: float = 0.65, high: float = 0.82, factor: float = 0.90) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), q75 * F.lit(factor)))


def cell_centre(index: Column, cells: Column | int, size: Column | float) -> Column:
    """Pixel coordinate of the middle of a grid cell."""
    cells = F.lit(cells) if isinstance(cells, int) else cells
    size = F.lit(float(size)) if isinstance(size, (int, float)) else size
    return (index + F.lit(0.5)) * size / cells


def normal_point(x: Column, size: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.greatest(F.lit(1), size)))


def resized_index(i: Column, source: Column, target: Column, centre: bool = True) -> Column:
    """Source index of target index i under nearest-neighbour scaling; centre: sample at the middle of a cell, else at its start."""
    return F.floor((i + F.lit(0.5 if centre else 0.0)) * source / target).cast("int")
