"""Vectors as arrays of float: norm, unit form, inner product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, epsilon: float = 1e-12, near: float = 1e-5) -> Column:
    """``v`` over its norm; left alone if that is 1 within ``near``, null if zero, NaN or infinite."""
    n = norm(v)
    ok = (n > epsilon) & ~F.isnan(n) & (n != float("inf"))
    return F.when(ok & (F.abs(n - 1) <= 2 * near), F.transform(v, lambda x: x.cast("double"))).when(ok, F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, held to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
