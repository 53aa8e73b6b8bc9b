"""Kernels that are true character automata, as vectorised functions of columns.

A kernel is a plain Python function of values. kernel_column() wraps it so that values cross to Python in Arrow batches
and each distinct tuple of a batch is worked out once: names and words repeat. distinct_first() goes further for a
whole DataFrame: it works on the distinct values of a column and joins the results back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .text import col


def hashable(value):
    return tuple(map(hashable, value)) if isinstance(value, list) else value


def kernel_column(kernel: Callable, kind: str, *args, **options) -> Column:
    """A column of kernel(*args, **options); null where any argument is null. kind is the DDL type of the result.

    Array arguments reach the kernel as tuples.
    """
    arrow_kind = to_arrow_type(_parse_datatype_string(kind))

    def one(*values):
        return None if any(v is None for v in values) else kernel(*values, **options)

    def run(*columns: pa.Array) -> pa.Array:
        known = lru_cache(None)(one)
        rows = zip(*(map(hashable, c.to_pylist()) for c in columns), strict=True)
        return pa.array([known(*row) for row in rows], arrow_kind)

    def single(a: pa.Array) -> pa.Array:
        return run(a)

    def pair(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(single if len(args) == 1 else pair, kind)(*map(col, args))


def distinct_first(df: DataFrame, column: str, name: str, of: Callable[[str], Column]) -> DataFrame:
    """df with of(column) as name, worked out once per distinct value of the column; Spark picks the join back."""
    known = df.select(column).distinct().withColumn(name, of(column)).withColumnRenamed(column, "__value")
    return df.join(known, df[column].eqNullSafe(known["__value"]), "left").drop("__value")
