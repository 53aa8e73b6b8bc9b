"""Vectors of equal dimension (arrays of doubles) as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import over
from .text import col


def doubles(c) -> Column:
    return col(c).cast("array<double>")


def total(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over both vectors' components; an error for unequal dimensions."""
    ok = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of unequal dimension"))
    return F.when(ok.isNull(), F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v))


def vec(n: int, fill: float = 0.0) -> Column:
    return F.array_repeat(F.lit(float(fill)), n)


def add(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def scale(a, by) -> Column:
    return F.transform(doubles(a), lambda x: x * by)


def dot(a, b) -> Column:
    return total(doubles(a), doubles(b), lambda x, y: x * y)


def mean(df: DataFrame, c, *by: str) -> DataFrame:
    """The component-wise mean of a column's vectors, per group: partial sums per position, no row is gathered."""
    each = df.select(*by, F.posexplode(doubles(c)).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def squared_euclidean(a, b) -> Column:
    return total(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return total(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def chebyshev(a, b) -> Column:
    ok = F.assert_true(F.size(col(a)) == F.size(col(b)), F.lit("vectors of unequal dimension"))
    return F.when(ok.isNull(), F.coalesce(F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))), F.lit(0.0)))


def minkowski(p: float, a, b) -> Column:
    if p < 1:
        raise ValueError("p must be 1 at least")
    return F.pow(total(doubles(a), doubles(b), lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def canberra(a, b) -> Column:
    """Sum of |x - y| / (|x| + |y|); NaN where both are 0."""
    return total(doubles(a), doubles(b), lambda x, y: over(F.abs(x - y), F.abs(x) + F.abs(y)))


def cosine(a, b) -> Column:
    """Cosine similarity; NaN for zero vectors."""
    return over(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def cosine_distance(a, b) -> Column:
    return 1 - cosine(a, b)
