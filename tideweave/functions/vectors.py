"""Column functions over ARRAY<DOUBLE>; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    """The column itself, or that of a name."""
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    """Sum of the elements."""
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    return total(F.zip_with(col(a), col(b), lambda u, v: u * v))


def mean(a: Column | str) -> Column:
    """Mean of the elements; null for an empty array."""
    return F.try_divide(total(a), F.size(col(a)))


def std(a: Column | str) -> Column:
    """Sample standard deviation of the elements."""
    m = mean(a)
    square = F.aggregate(F.transform(col(a), lambda v: (v - m) * (v - m)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.try_divide(square, F.size(col(a)) - 1))


def scaled(a: Column | str, factor: Column, shift: Column | float = 0.0) -> Column:
    """(element - shift) * factor."""
    return F.transform(col(a), lambda v: (v - shift) * factor)


def softmax(a: Column | str) -> Column:
    """exp(element) over their sum, shifted by the largest, so that nothing overflows."""
    top = F.array_max(col(a))
    weights = F.transform(col(a), lambda v: F.exp(v - top))
    whole = F.aggregate(F.transform(col(a), lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
    return F.transform(weights, lambda v: v / whole)


def matvec(matrix: Column | str, width: int, vector: Column | str) -> Column:
    """Product of a row-major matrix, an array of rows * width elements, with a vector of `width` elements."""
    rows = F.sequence(F.lit(0), (F.size(col(matrix)) / width).cast("int") - 1)
    return F.transform(rows, lambda k: dot(F.slice(col(matrix), k * width + 1, width), vector))
