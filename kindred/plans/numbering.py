"""Numbering rows in a global order without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch | None = None) -> DataFrame:
    """df with a row number from 0 in the order, which should leave no ties.

    Rows are dealt into ranges of the order and written; a row's number is its place in its range plus the sizes of the
    ranges before, of which there is one row each.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    dealt = scratch.freeze(dealt, f"ranges_{name}")
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__part").agg(F.count("*").alias("__size")).select("__part", F.coalesce(F.sum("__size").over(line), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__part", "__place", "__before")
