"""Record linkage: which rows are alike, and clusters of them.

Items are a DataFrame with an id column, whose order stands for the order of the items, and any other columns. Distances
and similarities are functions of two struct columns (a row of each side) that give a Column. A pair is alike if the
distance is within the radius, or 0 without one; or if the similarity reaches the radius, or is true without one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.numbering import numbered
from kindred.plans.scratch import Scratch
from kindred.plans.stars import leaders, placed, star_clusters

Pairwise = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Alike:
    """When two rows are alike."""

    distance: Pairwise | None = None
    similarity: Pairwise | None = None
    radius: float | None = None

    def __post_init__(self):
        if self.distance is None and self.similarity is None:
            raise ValueError("a distance or a similarity is needed")
        if self.radius is not None and not isinstance(self.radius, (int, float)):
            raise ValueError("the radius must be a number")

    def __call__(self, a: Column, b: Column) -> Column:
        if self.distance is not None:
            return self.distance(a, b) <= self.radius if self.radius is not None else self.distance(a, b) == 0
        value = self.similarity(a, b)
        return value >= self.radius if self.radius is not None else value.cast("boolean")


def sides(items: DataFrame, id_col: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The items as (src, a, ...) and as (dst, b, ...)."""
    row = F.struct(*items.columns)
    return tuple(items.select(F.col(id_col).cast("long").alias(i), row.alias(s), *more) for i, s in (("src", "a"), ("dst", "b")))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def alike_pairs(pairs: DataFrame, alike: Pairwise) -> DataFrame:
    return pairs.where(alike(F.col("a"), F.col("b"))).select("src", "dst")


def naive_pairs(items: DataFrame, alike: Pairwise, id_col: str = "id") -> DataFrame:
    """(src, dst), src < dst, of all pairs that are alike: every pair is compared, so for small tables only."""
    a, b = sides(items, id_col)
    return alike_pairs(a.join(b, F.col("src") < F.col("dst")), alike)


def naive(items: DataFrame, alike: Pairwise, id_col: str = "id", min_size: int = 2) -> DataFrame:
    return star_clusters(both_ways(naive_pairs(items, alike, id_col)), min_size)


def blocking_pairs(items: DataFrame, keys: Column, alike: Pairwise, id_col: str = "id") -> DataFrame:
    """Pairs among rows that share one of their keys (an array column): an equi-join that Spark can split where a key
    is common; a pair that shares several keys is compared once. Null and empty keys are passed over."""
    keyed = items.withColumn("__key", F.explode(F.array_distinct(keys))).where("__key IS NOT NULL AND __key <> ''")
    ids = keyed.select("__key", F.col(id_col).cast("long").alias("src"))
    pairs = ids.join(ids.withColumnRenamed("src", "dst"), "__key").where("src < dst").select("src", "dst").distinct()
    a, b = sides(items, id_col)
    return alike_pairs(pairs.join(a, "src").join(b, "dst"), alike)


def blocking(items: DataFrame, keys: Column, alike: Pairwise, id_col: str = "id", min_size: int = 2) -> DataFrame:
    return star_clusters(both_ways(blocking_pairs(items, keys, alike, id_col)), min_size)


def key_collision(items: DataFrame, keys: Column, value: str, min_size: int = 2) -> DataFrame:
    """(key, members) of the distinct values that share a key (of an array of keys), where there are min_size at least."""
    keyed = items.select(F.explode(F.array_distinct(keys)).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND key <> ''").distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("members"))
    return sizes.where(F.col("n") >= min_size).select("key", "members")


def key_collision_merged(items: DataFrame, keys: Column, id_col: str = "id", min_size: int = 2) -> DataFrame:
    """Star clusters over rows that share a key: leaders take all rows that share one of their keys.

    A row that is the first left of each of its keys leads; rows that share a key with it are no longer free. Rounds of
    this work on (row, key) pairs, never on pairs of rows, so a key that many rows share costs as many rows.
    """
    scratch = Scratch(items.sparkSession)
    keyed = items.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(keys)).alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    keyed = scratch.freeze(keyed, "keyed")
    # rows that share keys with min_size - 1 others at least may lead; for clusters of two, those of any shared key
    shared = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("id", "key")
    if min_size > 2:
        others = shared.join(shared.withColumnRenamed("id", "other"), "key").where("id <> other").select("id", "other").distinct()
        able = others.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_size).select("id")
        free = shared.join(able, "id", "left_semi")
    else:
        free = shared
    free, lead, k = scratch.freeze(free, "free"), None, 0
    while not free.isEmpty():
        first = free.groupBy("key").agg(F.min("id").alias("first"))
        now = free.join(first, "key").groupBy("id").agg(F.min((F.col("id") == F.col("first")).cast("int")).alias("all")).where("all = 1").select("id")
        now = scratch.freeze(now, f"lead{k}")
        lead = now if lead is None else lead.union(now)
        taken = shared.join(shared.join(now, "id", "left_semi").select("key").distinct(), "key", "left_semi").select("id").distinct()
        free = scratch.freeze(free.join(taken, "id", "left_anti"), f"free{k}")
        k += 1
    if lead is None:
        return placed(shared.select(F.col("id").alias("cluster_id"), "id").limit(0))
    heads = shared.join(lead, "id", "left_semi").select(F.col("id").alias("cluster_id"), "key")
    members = heads.join(shared, "key").select("cluster_id", "id").distinct()
    return placed(members, F.col("id") != F.col("cluster_id"))


def snm_pairs(items: DataFrame, orders: list[list[Column]], window: int, alike: Pairwise, id_col: str = "id") -> DataFrame:
    """Pairs at most window rows apart in one of several orders. Ties keep the order before (at first by id)."""
    if window < 1:
        raise ValueError("the window must be 1 at least")
    scratch = Scratch(items.sparkSession)
    rows, before, pairs = items, F.col(id_col), None
    for k, order in enumerate(orders):
        rows = scratch.freeze(numbered(rows, [*order, before], f"__at{k}", scratch), f"order{k}")
        before = F.col(f"__at{k}")
        near = rows.select(F.col(id_col).cast("long").alias("src"), F.explode(F.sequence(F.col(f"__at{k}") + 1, F.col(f"__at{k}") + window)).alias("at"))
        found = near.join(rows.select(F.col(id_col).cast("long").alias("dst"), F.col(f"__at{k}").alias("at")), "at").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        pairs = found if pairs is None else pairs.union(found)
    a, b = sides(items, id_col)
    return alike_pairs(pairs.distinct().join(a, "src").join(b, "dst"), alike)


def sorted_neighborhood(items: DataFrame, orders: list[list[Column]], window: int, alike: Pairwise, id_col: str = "id", min_size: int = 2) -> DataFrame:
    return star_clusters(both_ways(snm_pairs(items, orders, window, alike, id_col)), min_size)


def canopy(items: DataFrame, distance: Pairwise, loose: float, tight: float, id_col: str = "id") -> DataFrame:
    """(cluster_id, pos, id): the first row left is a centre; it takes all rows left within loose, and those within
    tight are no longer left. Clusters of one are kept."""
    if loose < tight:
        raise ValueError("loose must not be less than tight")
    scratch = Scratch(items.sparkSession)
    a, b = sides(items, id_col)
    near = a.join(b, F.col("src") < F.col("dst")).withColumn("d", distance(F.col("a"), F.col("b"))).where(F.col("d") <= loose)
    near = scratch.freeze(near.select("src", "dst", "d"), "near")
    ids = items.select(F.col(id_col).cast("long").alias("id"))
    centres = leaders(near.where(F.col("d") <= tight).select("src", "dst"), scratch, rows=ids)
    centre = centres.select(F.col("id").alias("src"))
    from_centres = near.join(centre, "src", "left_semi")
    removed = from_centres.where(F.col("d") <= tight).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("by"))
    gone = removed.union(centres.select("id", F.col("id").alias("by"))).groupBy("id").agg(F.min("by").alias("by"))
    members = from_centres.select(F.col("src").alias("cluster_id"), F.col("dst").alias("id")).join(gone, "id", "left").where("by IS NULL OR by >= cluster_id")
    return placed(members.select("cluster_id", "id").union(centres.select(F.col("id").alias("cluster_id"), "id")))


def leader(items: DataFrame, distance: Pairwise, threshold: float, id_col: str = "id") -> DataFrame:
    """(cluster_id, pos, id): each row joins the nearest leader before it within the threshold, or leads itself."""
    scratch = Scratch(items.sparkSession)
    a, b = sides(items, id_col)
    near = a.join(b, F.col("src") < F.col("dst")).withColumn("d", distance(F.col("a"), F.col("b"))).where(F.col("d") <= threshold)
    near = scratch.freeze(near.select("src", "dst", "d"), "near")
    ids = items.select(F.col(id_col).cast("long").alias("id"))
    lead = leaders(near.select("src", "dst"), scratch, rows=ids)
    joins = near.join(lead.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("d", "src")).alias("cluster_id"))
    return placed(joins.select("cluster_id", "id").union(lead.select(F.col("id").alias("cluster_id"), "id")))


def metric_range_pairs(items: DataFrame, distance: Pairwise, radius: float, id_col: str = "id", pivots: int = 4) -> DataFrame:
    """Pairs within a radius under a metric, for an index-free range join.

    Every row has its distances to a few pivots. By the triangle inequality two rows within the radius differ by no more
    than it in each of them, so rows meet only in neighbouring bands of the first, and the others are tested first.
    """
    row = F.struct(*items.columns)
    some = items.orderBy(F.xxhash64(*items.columns)).limit(pivots)
    named = F.broadcast(some.agg(F.collect_list(row).alias("__pivots")))  # one row of pivots
    known = items.crossJoin(named).withColumn("__d", F.transform("__pivots", lambda p: distance(row, p).cast("double"))).drop("__pivots")
    band = F.floor(F.get("__d", F.lit(0)) / max(radius, 1e-9)).cast("long")
    a, b = (known.select(F.col(id_col).cast("long").alias(i), row.alias(s), F.col("__d").alias(f"d_{s}"), band.alias(f"band_{s}")) for i, s in (("src", "a"), ("dst", "b")))
    a = a.withColumn("band", F.explode(F.array(*(F.col("band_a") + k for k in (-1, 0, 1)))))
    near = F.forall(F.zip_with("d_a", "d_b", lambda x, y: F.abs(x - y)), lambda d: d <= radius)
    pairs = a.join(b, F.col("band") == F.col("band_b")).where((F.col("src") < F.col("dst")) & near)
    return pairs.where(distance(F.col("a"), F.col("b")) <= radius).select("src", "dst")


def vp_tree(items: DataFrame, distance: Pairwise, radius: float, id_col: str = "id", min_size: int = 2) -> DataFrame:
    """Star clusters of the range join; distance must be one that Column functions express."""
    return star_clusters(both_ways(metric_range_pairs(items, distance, radius, id_col)), min_size)


def exact_knn(items: DataFrame, similarity: Pairwise, k: int, id_col: str = "id") -> DataFrame:
    """(src, dst, similarity, rank) by comparing every pair: for small tables, and to check the approximate graph."""
    a, b = sides(items, id_col)
    every = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", similarity(F.col("a"), F.col("b")).cast("double").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_vector_knn(items: DataFrame, vector: str, k: int, id_col: str = "id", block: int = 4096) -> DataFrame:
    """(src, dst, similarity, rank): the k rows with the largest cosine to each, by matrix products of two blocks of
    rows at a time. A block sends on its k best for each row only; every block still meets every other, so for tables
    of some million rows at most, and to check approximate graphs. Vectors that are null, zero, hold null or non-finite
    components or have another length than most take no part."""
    import numpy as np
    import pyarrow as pa

    v = F.col(vector).cast("array<double>")
    rows = items.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return items.sparkSession.createDataFrame([], "src long, dst long, similarity double, rank int")
    rows = rows.where(F.size("v") == common["n"])
    blocks = max(1, -(-common["count"] // block))
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        def unit(t: pa.Table):
            x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return t["id"].to_numpy(), x / np.sqrt((x * x).sum(1))[:, None]

        src, dst, score = ([np.empty(0, t)] for t in (np.int64, np.int64, float))
        if left.num_rows and right.num_rows:
            (a, x), (b, y) = unit(left), unit(right)
            for p in range(0, len(a), 512):
                s = x[p : p + 512] @ y.T
                s[a[p : p + 512, None] == b[None]] = -np.inf
                # all that reach the k-th best, ties included
                i, j = np.nonzero(s >= np.partition(s, -min(k, s.shape[1]), axis=1)[:, [-min(k, s.shape[1])]] - 1e-12)
                ok = np.isfinite(s[i, j])
                src.append(a[p : p + 512][i[ok]]), dst.append(b[j[ok]]), score.append(s[i[ok], j[ok]])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "similarity": np.concatenate(score)})

    left = rows.select("id", "v", own.alias("i"), every.alias("j")).groupBy("i", "j")
    right = rows.select("id", "v", every.alias("i"), own.alias("j")).groupBy("i", "j")
    found = left.cogroup(right).applyInArrow(best, "src long, dst long, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nn_descent(items: DataFrame, similarity: Pairwise, k: int, rho: float = 0.5, delta: float = 0.001, max_iterations: int = 20, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(src, dst, similarity, rank): an approximate graph of the k most similar rows, from random neighbours on.

    In each round rows that have a common neighbour are compared, new neighbours (a share rho of them) with all; a row
    keeps its best k. It ends when no more than delta * rows * k neighbours have changed. Choices follow from hashes of
    ids and the seed, so that tasks which run again choose alike.
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    n = items.count()
    a, b = sides(items, id_col)
    draw = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    order = numbered(items.select(F.col(id_col).cast("long").alias("id")), [F.xxhash64("id", F.lit(seed)), F.col("id")], "at", scratch)
    start = order.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + k)).alias("to")).withColumn("at", F.pmod("to", F.lit(max(n, 1)).cast("long")))
    start = start.join(order.select(F.col("id").alias("dst"), "at"), "at").where("src <> dst").select("src", "dst").distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", similarity(F.col("a"), F.col("b")).cast("double").alias("similarity"))

    def best(edges: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
        return edges.withColumn("rank", rank).where(F.col("rank") <= k)

    graph = scratch.freeze(best(scored(start)).withColumn("new", F.lit(True)), "graph")
    for i in range(max_iterations):
        around = graph.select("src", "dst", "new").union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new")).groupBy("src", "dst").agg(F.max("new").alias("new"))
        around = around.withColumn("new", F.col("new") & (draw("src", "dst", F.lit(i)) < rho))
        x, y = (around.select("src", F.col("dst").alias(s), F.col("new").alias(f"new_{s}")) for s in "xy")
        # of a row's neighbours and those it is a neighbour of, a hub's are thinned to about 4 k
        wide = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(i), F.lit(seed), "x"))
        x = x.withColumn("r", F.row_number().over(wide)).where(F.col("r") <= 4 * k).drop("r")
        y = x.select("src", F.col("x").alias("y"), F.col("new_x").alias("new_y"))
        met = x.join(y, "src").where("x <> y AND (new_x OR new_y)").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
        fresh = scored(met.join(graph.select("src", "dst"), ["src", "dst"], "left_anti")).withColumn("new", F.lit(True))
        old = graph.select("src", "dst", "similarity", "new").join(around.where("new").select("src", "dst").withColumn("used", F.lit(True)), ["src", "dst"], "left").withColumn("new", F.col("new") & F.col("used").isNull()).drop("used")
        graph = scratch.freeze(best(old.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))), f"graph{i}")
        changed = graph.where("fresh").count()
        graph = graph.drop("fresh")
        if changed <= delta * n * k:
            break
    return graph.select("src", "dst", "similarity", "rank")
