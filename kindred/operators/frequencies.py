"""Counts of values: over rows, per row, relative, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.metrics import counts
from kindred.functions.text import col


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """(value, count) of a column's values, or of the elements of an array column."""
    each = F.explode(value) if dict(df.dtypes)[value].startswith("array") else F.col(value)
    return df.select(each.alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def relative(freqs: DataFrame) -> DataFrame:
    """(value, share) of (value, count)."""
    total = freqs.agg(F.sum("count").alias("__total"))
    return freqs.crossJoin(F.broadcast(total)).select("value", (F.col("count") / F.col("__total")).alias("share"))  # one row


def updated(before: DataFrame, more: DataFrame) -> DataFrame:
    """Two frequency tables as one."""
    return before.select("value", "count").union(more.select("value", "count")).groupBy("value").agg(F.sum("count").alias("count"))


def row_frequencies(c) -> Column:
    """An array's elements with their counts, as a map."""
    return F.map_from_entries(F.transform(counts(col(c)), lambda e: F.struct(e["x"], e["n"].cast("long"))))


def row_relative(c) -> Column:
    a = col(c)
    return F.map_from_entries(F.transform(counts(a), lambda e: F.struct(e["x"], e["n"] / F.size(a))))


def row_updated(before, more) -> Column:
    """A map of counts with another's added."""
    return F.map_zip_with(col(before), col(more), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def ranked(freqs: DataFrame, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    best = freqs.orderBy(F.desc("count"), "value").limit(k)  # each task keeps its k best
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "value")))
