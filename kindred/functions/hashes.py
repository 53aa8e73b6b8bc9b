"""Hashes as Column expressions: signed crc32, MinHash signatures and their bands."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.numbering import numbered

from .text import chars, col

PRIME = 4294967311.0  # fixed value: the prime after 2 ** 32, modulus of the signatures


def crc32(c) -> Column:
    """crc32 of the UTF-8 bytes as a signed 32-bit number."""
    h = F.crc32(F.encode(col(c), "UTF-8"))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def coefficients(hashes: int = 128, seed: int = 0) -> list[tuple[float, float]]:
    """Pairs for hashes hash functions, each number drawn once."""
    draw, top = random.Random(seed), (1 << 32) - 1
    a, b = (draw.sample(range(top), hashes) for _ in range(2))
    return [(float(x), float(y)) for x, y in zip(a, b, strict=True)]


def minhash(c, pairs: list[tuple[float, float]], array: bool = False) -> Column:
    """The least (a token + b) mod PRIME per pair, in double precision with the dividend's sign; infinity for no token.

    Tokens are a string's distinct character codes, or the signed crc32 of an array's distinct elements.
    """
    tokens = F.transform(F.array_distinct(col(c)), crc32) if array else F.transform(F.array_distinct(chars(c)), lambda x: F.expr("0") + F.ascii(x))
    tokens = F.transform(tokens, lambda t: t.cast("double"))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    least = lambda p: F.array_min(F.transform(tokens, lambda t: (p["a"] * t + p["b"]) % PRIME))
    return F.transform(table, lambda p: F.coalesce(least(p), F.lit(float("inf"))))


def bands(signature, rows: int, size: int) -> Column:
    """(band, key) for each rows consecutive values of a signature of size values."""
    if size % rows:
        raise ValueError("rows must divide the signature's length")
    s = col(signature)
    key = lambda i: F.concat_ws(",", F.transform(F.slice(s, i * rows + 1, rows), lambda v: v.cast("string")))
    return F.transform(F.sequence(F.lit(0), F.lit(size // rows - 1)), lambda i: F.struct(i.alias("band"), key(i).alias("key")))


def binning(df: DataFrame, id_col: str, signature: str, rows: int, size: int) -> DataFrame:
    """(id, band, bin): rows that share a bin agree on a band. Bins are numbered from 0 by their first row."""
    each = df.select(F.col(id_col).alias("id"), F.explode(bands(signature, rows, size)).alias("b")).select("id", "b.band", "b.key")
    first = each.groupBy("band", "key").agg(F.min("id").alias("first"))
    bins = numbered(first, [F.asc("first"), F.asc("band"), F.asc("key")], "bin")
    return each.join(bins.select("band", "key", "bin"), ["band", "key"]).select("id", "band", "bin")
