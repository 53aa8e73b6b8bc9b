"""Counts and signatures over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import hashes


def stream_frequencies(stream: DataFrame, value: str, ts: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(value, count), or per window of event time with a watermark: the state grows with the values inside the
    watermark only. Without a time the counts are those of the whole stream (complete or update mode)."""
    if ts is None:
        return stream.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("count"))
    timed = stream.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(value).alias("value")).agg(F.count("*").alias("count"))
    return timed.select(F.col("window.start").alias("start"), "value", "count")


def stream_signatures(stream: DataFrame, column: str, pairs: list[tuple[float, float]], name: str = "signature") -> DataFrame:
    """MinHash signatures of a stream's texts; stateless, as all Column functions of the library are."""
    signature: Column = hashes.minhash(column, pairs)
    return stream.withColumn(name, signature)


def upsert_frequencies(batch: DataFrame, path: str, value: str) -> None:
    """For foreachBatch: add a batch's counts to a table at path/<epoch>; total_frequencies() reads the sum.

    Each batch appends its own counts, so that a batch that runs again after a failure can replace what it wrote.
    """
    batch.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("count")).write.mode("overwrite").parquet(path)


def total_frequencies(batches: DataFrame) -> DataFrame:
    return batches.groupBy("value").agg(F.sum("count").alias("count"))
