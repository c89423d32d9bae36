"""Vectors as arrays, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / (n + 1e-9))


def blend(old: Column, new: Column, alpha: float) -> Column:
    """Unit vector of the moving average that gives ``new`` the weight ``alpha``."""
    return unit(F.zip_with(old, new, lambda x, y: x * (1.0 - alpha) + y.cast("double") * alpha))
