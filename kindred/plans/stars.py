"""Greedy star clusters of a similarity graph: the first row that is still free leads, with all its neighbours.

Rows in ascending id order lead a cluster unless an earlier leader has them as a neighbour; neighbours may be in several
clusters. This is the lexicographically first independent set of the graph, found here in rounds: a row leads as soon as
no undecided row before it has it as a neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def leaders(edges: DataFrame, scratch: Scratch, tag: str = "stars", rows: DataFrame | None = None) -> DataFrame:
    """(id) of the leaders. edges: (src, dst); only those that lead to a larger id between eligible ids decide.

    rows: the eligible ids (id), if not just all in edges.
    """
    ids = rows if rows is not None else edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    open_ = scratch.freeze(ids, f"{tag}_open")
    downward = edges.where("src < dst").distinct()
    downward = downward.join(open_.select(F.col("id").alias("src")), "src", "left_semi").join(open_.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    downward = scratch.freeze(downward, f"{tag}_edges")
    found, k = None, 0
    while not open_.isEmpty():
        waiting = downward.select(F.col("dst").alias("id")).distinct()
        lead = scratch.freeze(open_.join(waiting, "id", "left_anti"), f"{tag}_lead{k}")
        found = lead if found is None else found.union(lead)
        covered = downward.join(lead.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        done = lead.union(covered)
        open_ = scratch.freeze(open_.join(done, "id", "left_anti"), f"{tag}_open{k}")
        left = open_.select("id")
        downward = scratch.freeze(downward.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), f"{tag}_edges{k}")
        k += 1
    return found if found is not None else open_


def star_clusters(edges: DataFrame, min_size: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(cluster_id, pos, id) of all clusters of min_size members at least; the leader's id names a cluster and comes first."""
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.freeze(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "graph")
    eligible = edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_size).select("id")
    lead = leaders(edges.where("src <> dst"), scratch, rows=eligible)
    stars = edges.where("src <> dst").join(lead.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("cluster_id"), F.col("dst").alias("id"))
    return placed(stars.union(lead.select(F.col("id").alias("cluster_id"), "id")), F.col("id") != F.col("cluster_id"))


def placed(members: DataFrame, *first: Column) -> DataFrame:
    """(cluster_id, pos, id): members numbered within their cluster."""
    from pyspark.sql import Window

    return members.withColumn("pos", (F.row_number().over(Window.partitionBy("cluster_id").orderBy(*first, "id")) - 1).cast("int")).select("cluster_id", "pos", "id")
