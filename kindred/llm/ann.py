"""Approximate nearest neighbours by multi-index hashing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

SAMPLE = 8_192  # bound on the vectors that rotation and radius are learned from
BITS, PART = 64, 16  # bits of a code at most, and of its substrings
TARGET = 0.97  # share of true neighbours within the radius, on the sample
ROWS_BLOCK, QUERY_BLOCK = 16_384, 2_048


@dataclass(frozen=True)
class Coder:
    """Binary codes: the signs of centred unit vectors after a learned rotation; and a radius that holds neighbours."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One row of substrings (unsigned 16-bit words) per vector."""
        bits = (unit - self.mean) @ self.turn > 0
        pad = np.zeros((len(bits), -bits.shape[1] % PART), bool)
        return np.packbits(np.hstack([bits, pad]), axis=1).view(">u2").astype(np.uint16)


def learn(unit: np.ndarray, k: int, seed: int = 1) -> Coder:
    """Iterative quantisation: principal axes, then the rotation under which signs lose least, by alternation.

    The radius is the least one within which TARGET of the k nearest vectors lie, judged inside the sample, whose
    neighbours are farther off than those in the whole table.
    """
    mean = unit.mean(0)
    axes = np.linalg.svd(unit - mean, full_matrices=False)[2][:BITS].T
    flat = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(30):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn, 0)
    asked = unit[:: max(1, len(unit) // 256)][:256]
    near = asked @ unit.T
    codes, own = coder.codes(unit), coder.codes(asked)
    far = np.bitwise_count(own[:, None, :] ^ codes[None]).sum(2, dtype=np.int64)
    # the first is the vector itself
    top = np.argsort(-near, axis=1, kind="stable")[:, 1 : k + 1]
    radius = int(np.quantile(np.take_along_axis(far, top, 1), TARGET, method="higher")) if top.size else codes.shape[1] * PART
    return Coder(mean, axes @ turn, radius)


@lru_cache(32)
def masks(distance: int) -> np.ndarray:
    """All words that differ from zero in some number of bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(PART), distance)], np.uint16)


class Index:
    """The codes of a block of vectors, with a table of each substring's values."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.order, self.cut = codes, [], []
        for j in range(codes.shape[1]):
            self.order.append(np.argsort(codes[:, j], kind="stable"))
            self.cut.append(np.r_[0, np.cumsum(np.bincount(codes[:, j], minlength=1 << PART))])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius, by pigeonhole: some substring is within its share of it."""
        parts = len(code)
        hit = np.zeros(len(self.codes), bool)
        share, rest = divmod(radius, parts)
        for j in range(parts):
            for d in range(min(PART, share if j <= rest else share - 1) + 1):
                at = masks(d) ^ code[j]
                begin, end = self.cut[j][at], self.cut[j][at.astype(np.int64) + 1]
                full = end > begin
                begin, size = begin[full], (end - begin)[full]
                if len(begin):
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    hit[self.order[j][np.repeat(begin, size) + step]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1, dtype=np.int64) <= radius]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def vectors_of(t: pa.Table) -> np.ndarray:
    v = t["vector"].combine_chunks()
    flat = v.values if not len(v) else v.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def searcher(coder: Coder, k: int):
    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            x, q = vectors_of(rows), vectors_of(asked)
            ids, lengths = rows["id"].to_numpy(), np.sqrt((x * x).sum(1))
            index = Index(coder.codes(x / lengths[:, None]))
            for query, v, code in zip(asked["id"].to_pylist(), q, coder.codes(unit_rows(q)), strict=True):
                radius = coder.radius
                while True:
                    found = index.within(code, radius)
                    found = found[ids[found] != query]
                    if len(found) >= k or radius >= PART * len(code):
                        break
                    radius += len(code)  # too few within it: each substring one bit wider
                score = (x[found] * v).sum(1) / (lengths[found] * np.sqrt((v * v).sum()))
                best = np.lexsort((ids[found], -score))[:k]
                out += zip([query] * len(best), ids[found][best].tolist(), score[best].tolist(), strict=True)
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = SAMPLE) -> DataFrame:
    """The k rows of vectors with the largest cosine to each row of queries, but the row with its own id.

    Vectors become binary codes, signs after a rotation learned on at most rows vectors (those with the smallest hash).
    Codes are split into substrings of 16 bits, each indexed; a code within the search radius agrees with the query's
    in some substring up to its share of the radius, so probing the substrings' neighbourhoods retrieves every code
    within it. What is retrieved is ranked by cosines of the original vectors in double precision. Where a block holds
    fewer than k codes within the radius, it widens. Vectors and queries meet in blocks of bounded size.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Vectors that are null, empty, zero, hold
    null or non-finite components or have another length than most (of equally common ones the least) take no part, nor do rows without
    an id. Repeated vectors are candidates each. With fewer than k others, all are returned; an empty table gives an
    empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
        finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return df.where(finite & F.exists("vector", lambda c: c != 0))

    good, asked = usable(vectors), usable(queries)
    common = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = common["size"]
    good, asked = (scratch.freeze(df.where(F.size("vector") == size), name) for df, name in ((good, "rows"), (asked, "queries")))
    sample = good.orderBy(F.xxhash64("id", "vector"), "id").limit(rows).collect()  # at most rows vectors
    coder = learn(unit_rows(np.array([r["vector"] for r in sample])), k)
    blocks, lots = (max(1, -(-df.count() // n)) for df, n in ((good, ROWS_BLOCK), (asked, QUERY_BLOCK)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows_by = good.select("id", "vector", part(blocks).cast("int").alias("block"), every(lots).alias("lot")).groupBy("block", "lot")
    asked_by = asked.select("id", "vector", every(blocks).alias("block"), part(lots).cast("int").alias("lot")).groupBy("block", "lot")
    found = rows_by.cogroup(asked_by).applyInArrow(searcher(coder, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
