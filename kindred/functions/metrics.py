"""Similarity of strings and sequences as Column expressions (no Python at run time).

Strings and arrays are both sequences: a string's elements are its characters. distance = 1 - similarity where both
exist. Null in: null out. NaN stands where a ratio of nothing to nothing is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chars, col


def nan() -> Column:
    return F.lit(float("nan"))


def over(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, nan()).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def seq(c, array: bool) -> Column:
    return col(c) if array else chars(c)


def length(c, array: bool) -> Column:
    return F.size(col(c)) if array else F.char_length(col(c))


def distance(similarity: Column) -> Column:
    return 1 - similarity


def identity_similarity(a, b) -> Column:
    return (col(a) == col(b)).cast("double")


def identity_distance(a, b) -> Column:
    return 1 - identity_similarity(a, b)


def length_similarity(a, b, array: bool = False) -> Column:
    """Shorter over longer; equal: 1."""
    x, y = length(a, array), length(b, array)
    return F.when(col(a) == col(b), 1.0).otherwise(over(F.least(x, y), F.greatest(x, y)))


def levenshtein(a, b) -> Column:
    """Unit-cost edit distance of strings."""
    return F.levenshtein(col(a), col(b))


def levenshtein_limited(limit: int, a, b) -> Column:
    """Edit distance, infinity beyond limit."""
    d = F.levenshtein(col(a), col(b), limit)
    return F.when(d < 0, float("inf")).otherwise(d.cast("double"))


def lig2(a, b) -> Column:
    """I / (I + C): C the edit distance, I the longer length without it."""
    c = levenshtein(a, b)
    i = F.greatest(F.char_length(col(a)), F.char_length(col(b))) - c
    return F.when(col(a) == col(b), 1.0).otherwise(over(i, i + c))


def lig3(a, b) -> Column:
    """2 I / (2 I + C)."""
    c = levenshtein(a, b)
    i = F.greatest(F.char_length(col(a)), F.char_length(col(b))) - c
    return F.when(col(a) == col(b), 1.0).otherwise(over(2 * i, 2 * i + c))


def counts(c: Column) -> Column:
    """(element, count) of an array."""
    return F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("x"), F.size(F.filter(c, lambda y: y == x)).alias("n")))


def bag(a, b, array: bool = False) -> Column:
    """The larger of the two multiset differences."""
    x, y = seq(a, array), seq(b, array)
    common = F.aggregate(counts(x), F.lit(0), lambda s, e: s + F.least(e["n"], F.size(F.filter(y, lambda v: v == e["x"]))))
    return F.greatest(F.size(x), F.size(y)) - common


def set_sizes(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Sizes of the intersection and of both differences of two arrays as sets."""
    return F.size(F.array_intersect(x, y)), F.size(F.array_except(x, y)), F.size(F.array_except(y, x))


def jaccard(a, b, array: bool = False) -> Column:
    x, y = seq(a, array), seq(b, array)
    i, u = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(col(a) == col(b), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(over(i, u))


def overlap(a, b, array: bool = False) -> Column:
    """Intersection over the smaller set."""
    x, y = seq(a, array), seq(b, array)
    least = F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    return F.when(col(a) == col(b), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(over(F.size(F.array_intersect(x, y)), least))


def tversky(a, b, alpha: float = 1, beta: float = 1, symmetric: bool = False, array: bool = False) -> Column:
    """Intersection over itself and the weighted differences. The symmetric form weighs the smaller and larger of them
    as beta (alpha min + (alpha - 1) ** max)."""
    if alpha < 0 or beta < 0:
        raise ValueError("alpha and beta must not be negative")
    i, xy, yx = set_sizes(seq(a, array), seq(b, array))
    if symmetric:
        return over(i, i + beta * (alpha * F.least(xy, yx) + F.pow(F.lit(float(alpha - 1)), F.greatest(xy, yx))))
    return over(i, i + alpha * xy + beta * yx)


def ngrams(c, n: int, array: bool = False) -> Column:
    """Every run of n elements: strings of a string, arrays of an array."""
    if n < 1:
        raise ValueError("n must be 1 at least")
    size = length(c, array)
    take = (lambda i: F.slice(col(c), i, n)) if array else (lambda i: F.substring(col(c), i, F.lit(n)))
    none = F.slice(F.array(col(c)), 1, 0)
    return F.when(size < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), take))


def dice(a, b, array: bool = False) -> Column:
    """Sets of bigrams: twice the intersection over both sizes; NaN if neither has any."""
    x, y = ngrams(a, 2, array), ngrams(b, 2, array)
    i, xy, yx = set_sizes(x, y)
    single = (length(a, array) == 1) & (length(b, array) == 1)
    return F.when(col(a) == col(b), 1.0).when(single, 0.0).otherwise(over(i, i + 0.5 * xy + 0.5 * yx))


sorensen = dice


def differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: (~u.eqNullSafe(v)).cast("int")), F.lit(0), lambda s, v: s + v)


def hamming(a, b, array: bool = False) -> Column:
    """Differing positions; an error for unequal lengths."""
    ok = F.assert_true(length(a, array) == length(b, array), F.lit("hamming: sequences of unequal length"))
    return F.when(ok.isNull(), differing(seq(a, array), seq(b, array)))


def hamming_normalized(a, b, array: bool = False) -> Column:
    """Share of differing positions of the longer sequence, whose tail counts as different."""
    longest = F.greatest(length(a, array), length(b, array))
    return F.when(col(a) == col(b), 0.0).otherwise(over(differing(seq(a, array), seq(b, array)), longest))


def hamming_bitwise(a, b) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def common_prefix(x: Column, y: Column) -> Column:
    same = F.zip_with(x, y, lambda u, v: u.eqNullSafe(v))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def prefix(a, b, array: bool = False) -> Column:
    """Common prefix over the shorter length."""
    least = F.least(length(a, array), length(b, array))
    return F.when(col(a) == col(b), 1.0).when(least == 0, 0.0).otherwise(over(common_prefix(seq(a, array), seq(b, array)), least))


def suffix(a, b, array: bool = False) -> Column:
    """Common suffix over the shorter length."""
    least = F.least(length(a, array), length(b, array))
    x, y = F.reverse(seq(a, array)), F.reverse(seq(b, array))
    return F.when(col(a) == col(b), 1.0).when(least == 0, 0.0).otherwise(over(common_prefix(x, y), least))


def monge_elkan(similarity: Callable[[Column, Column], Column], a, b) -> Column:
    """Of each element of a array the best similarity to one of b, on average. Not symmetric."""
    x, y = col(a), col(b)
    best = F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: similarity(u, v))))
    total = F.aggregate(best, F.lit(0.0), lambda s, v: s + v)
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(x == y, 1.0).when(none, 0.0).otherwise(total / F.greatest(F.size(x), F.lit(1)))


def monge_elkan_symmetric(similarity: Callable[[Column, Column], Column], a, b) -> Column:
    return (monge_elkan(similarity, a, b) + monge_elkan(similarity, b, a)) / 2


def minhash_similarity(a, b) -> Column:
    """Share of equal positions of two signatures of one length."""
    ok = F.assert_true(F.size(col(a)) == F.size(col(b)), F.lit("minhash: signatures of unequal length"))
    return F.when(ok.isNull(), 1 - differing(col(a), col(b)) / F.size(col(a)))


def eudex_distance(a, b) -> Column:
    """Weighted differing bits of two eudex hashes: the k-th byte's count times 2 ** k."""
    d = col(a).bitwiseXOR(col(b))
    return sum((F.bit_count(F.shiftrightunsigned(d, 8 * k).bitwiseAND(255)) * (1 << k) for k in range(8)), F.lit(0))


def eudex_similar(a, b) -> Column:
    return eudex_distance(a, b) < 10
