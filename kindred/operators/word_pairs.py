"""Distances of all pairs of words in a block, worked out for many pairs at once.

Blocks are cut into parts of at most PART words, and pairs of parts are dealt out evenly, so that a task's work does not
follow the size of a block. A task makes the pairs itself: only words travel to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.sequences import lipns, longest_common_run, within_mismatches
from kindred.plans.scratch import Scratch, partitions

PART, STEP, WORDS = 512, 1 << 15, 20_000  # words of a part, pairs that are compared at once, words that are coded at once
LONG = 64  # characters; pairs with a longer word are compared one by one


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a row of codes from 2 on for each word's first LONG characters, then zeros."""
    short = [w[:LONG] for w in words]
    lengths = np.array([len(w) for w in words], np.int64)
    distinct, at = np.unique(np.frombuffer("".join(short).encode("utf-32-le"), np.uint32), return_inverse=True)
    codes = np.zeros((len(words), min(LONG, int(lengths.max(initial=0)))), np.uint8 if len(distinct) < 254 else np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = at + 2
    return codes, lengths


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which two words agree, length of their longest common run) of columns of codes; ends of a and b are
    filled up with codes that differ. Runs are counted along each diagonal."""
    (n, pairs), (m, _) = a.shape, b.shape
    agree, longest, run, same = np.zeros(pairs, np.uint8), np.zeros(pairs, np.uint8), np.empty(pairs, np.uint8), np.empty(pairs, bool)
    bits = same.view(np.uint8)
    for shift in range(1 - m, n):
        run[:] = 0
        for i in range(max(shift, 0), min(n, m + shift)):
            np.equal(a[i], b[i - shift], out=same)
            run += 1
            run *= bits
            np.maximum(longest, run, out=longest)
            if not shift:
                agree += bits
    return agree, longest


def rounded(x, places: int):
    return np.floor(x * 10.0**places + 0.5) / 10.0**places


def pairs_of(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words in pairs, about STEP at a time: x words from first on, each with the y after them, or, where y is
    0, all pairs of the x."""
    own = y == 0
    wide = np.where(own, x, y)
    ends = np.cumsum(x * wide)
    for low in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        k = np.arange(low, min(low + STEP, int(ends[-1])))
        t = np.searchsorted(ends, k, "right")
        i, j = np.divmod(k - (ends - x * wide)[t], wide[t])
        keep = ~own[t] | (i < j)
        t, i, j = t[keep], i[keep], j[keep]
        yield first[t] + i, first[t] + j + np.where(own[t], 0, x[t])


def distances(places: int):
    single = [[within_mismatches(d, size) if size else 1 for size in range(LONG + 1)] for d in range(LONG + 1)]

    def rows(xs: list[list[str]], ys: list[list[str]]) -> Iterator[pa.RecordBatch]:
        words = [w for x, y in zip(xs, ys, strict=True) for w in (*x, *y)]
        x, y = (np.array([len(s) for s in z], np.int64) for z in (xs, ys))
        codes, lengths = coded(words)
        ends, texts, near = np.where(codes == 0, 1, codes).astype(codes.dtype), pa.array(words, pa.string()), np.array(single, np.int32)
        for a, b in pairs_of(x, y, np.cumsum(x + y) - x - y):
            la, lb = lengths[a], lengths[b]
            size = np.maximum(la, lb)
            agree, run = compared(np.ascontiguousarray(codes[a, : la.max(initial=0)].T), np.ascontiguousarray(ends[b, : lb.max(initial=0)].T))
            apart, run = size - agree, run.astype(np.int64)
            mlipns = near[np.minimum(apart, LONG), np.minimum(size, LONG)]
            for k in np.flatnonzero(size > LONG):
                one, two = words[a[k]], words[b[k]]
                apart[k], run[k] = lipns(one, two), longest_common_run(one, two)[0]
                mlipns[k] = within_mismatches(int(apart[k]), int(size[k]))
            columns = [texts.take(pa.array(a)), texts.take(pa.array(b)), pa.array(apart.astype(np.int32)), pa.array(mlipns), pa.array(rounded(run / size, places))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "lipns", "mlipns", "lcs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, held = [], [], 0
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].as_py() for c in (0, 1))
                xs.append(x)
                ys.append(y)
                held += len(x) + len(y)
                if held >= WORDS or k + 1 == batch.num_rows:
                    yield from rows(xs, ys)
                    xs, ys, held = [], [], 0

    return run


def block_distances(words: DataFrame, word: str, keys: list[str], places: int = 6) -> DataFrame:
    """(a, b, lipns, mlipns, lcs) of all pairs a < b of distinct, non-empty words with the same keys; lcs is rounded."""
    spark = words.sparkSession
    part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(word)) - 1) / PART)
    parts = words.withColumn("part", part).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(word)).alias("x"))
    parts = Scratch(spark).freeze(parts, "parts")
    other = parts.select(*keys, F.col("part").alias("part_y"), F.col("x").alias("y"))
    tiles = parts.join(other, keys).where("part < part_y OR (part = part_y AND size(x) > 1)")
    tiles = tiles.select("x", F.when(F.col("part") < F.col("part_y"), F.col("y")).otherwise(F.array().cast("array<string>")).alias("y"))
    return tiles.repartition(partitions(spark)).mapInArrow(distances(places), "a string, b string, lipns int, mlipns int, lcs double")
