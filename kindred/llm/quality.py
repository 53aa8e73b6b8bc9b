"""Quality classifier: a generalised additive model with pairwise interactions (GA2M), boosted in cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import portions
from .substring_dedup import SPACE, word_names

TRAINING_ROWS = 20_000  # bound on the labelled rows that a model is fitted on
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 120, 0.15, 6, 8

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "stops", "marks", "symbols", "word_bytes", "distinct_words",
    "same_as_before", "commonest_word", "symbol_starts", "symbol_ends", "line_words",
)

#: Byte classes: other, letter (and any byte of a longer character), capital, digit, white space, .,;:? , !, symbol.
CLASS = np.full(256, 7, np.uint8)
CLASS[:0x20] = 0
CLASS[SPACE] = 4
for _c, _s in ((5, ".,;:?"), (6, "!"), (3, "0123456789"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (1, "abcdefghijklmnopqrstuvwxyz")):
    CLASS[[ord(x) for x in _s]] = _c
CLASS[0x80:] = 1


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; all zero for an empty one."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *map(measure, portions(texts))])


def measure(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    sizes = np.array([len(x) for x in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    kind, doc = CLASS[raw], np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    lines = np.bincount(doc[raw == 10], minlength=n) + 1.0
    names, _, words = word_names(texts)
    of = np.repeat(np.arange(n), words)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    per_word = lambda hit: share(np.bincount(of[hit], minlength=n).astype(float), words)
    order = np.lexsort((names, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (names[order][1:] != names[order][:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, of[order][first], np.diff(np.r_[first, len(of)]))
    same = np.r_[False, (of[1:] == of[:-1]) & (names[1:] == names[:-1])] if len(of) else np.zeros(0, bool)
    # a word begins or ends where white space, or another document, is next to it
    solid = kind != 4
    left = np.r_[True, ~solid[:-1] | (doc[1:] != doc[:-1])] if len(raw) else solid
    right = np.r_[~solid[1:] | (doc[1:] != doc[:-1]), True] if len(raw) else solid
    odd = (kind == 7) | (kind == 6)
    edge = lambda at: share(np.bincount(doc[solid & odd & at], minlength=n).astype(float), words)
    size, letters = sizes.astype(float), counts[:, 1] + counts[:, 2]
    return np.column_stack([
        np.log1p(size), share(letters, size), share(counts[:, 2], letters), share(counts[:, 3], size), share(counts[:, 4], size),
        share(counts[:, 5], size), share(counts[:, 6], size), share(counts[:, 7], size), share(size - counts[:, 4], words),
        share(np.bincount(of[order][first], minlength=n).astype(float), words), per_word(same), share(most, words),
        edge(left), edge(right), np.where(words > 0, np.log1p(words / lines), 0),
    ])


def split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins, and the first bin right of it (0: none)."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    c, d = g.sum() - a, h.sum() - b
    gain = np.where((b > 1e-3) & (d > 1e-3), a * a / (b + 1) + c * c / (d + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1))


def shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over one feature's bins, as the value of each bin."""
    out, (_, k) = np.zeros(len(g)), split(g, h)
    for lo, hi in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        _, m = split(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + m), (lo + m, hi)) if m else ((lo, hi),):
            out[a:b] = leaf(g[a:b], h[a:b])
    return out


def crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better tree of depth two that cuts a grid of bins by one feature and then by the other, and its gain."""
    best, values = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        u, v = (g.T, h.T) if flip else (g, h)
        total, k = split(u.sum(1), v.sum(1))
        out = np.zeros(u.shape)
        for rows in (slice(0, k), slice(k, None)) if k else (slice(None),):
            more, m = split(u[rows].sum(0), v[rows].sum(0))
            total += more
            for cols in (slice(0, m), slice(m, None)) if m else (slice(None),):
                out[rows, cols] = leaf(u[rows, cols], v[rows, cols])
        if total > best:
            best, values = total, out.T if flip else out
    return best, values


@dataclass
class AdditiveModel:
    """Sum of one lookup table per feature and one per chosen pair, through the logistic function."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b[:, j] * PAIR_BINS // (len(self.cuts[j]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[self.coarse(b, i), self.coarse(b, j)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables of all features in turn, choose the pairs that explain most of the rest, boost those in turn."""
    model = AdditiveModel()
    if not len(y) or y.min() == y.max():
        model.base = 0.0 if not len(y) else 4.0 if y[0] else -4.0  # one class only: a confident constant
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    b, z = model.bins(x), np.full(len(y), model.base)
    width = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(w) for w in width]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, w in enumerate(width):
            g, h = slopes()
            step = RATE * shallow(np.bincount(b[:, j], g, w), np.bincount(b[:, j], h, w))
            model.tables[j] += step
            z += step[b[:, j]]
    grid = lambda i, j, v: np.bincount(model.coarse(b, i) * PAIR_BINS + model.coarse(b, j), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    ranked = sorted(combinations(range(len(width)), 2), key=lambda p: -crossed(grid(*p, g), grid(*p, h))[0])
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in ranked[:PAIRS]}
    for _ in range(ROUNDS // 4):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            step = RATE * crossed(grid(i, j, g), grid(i, j, h))[1]
            t += step
            z += step[model.coarse(b, i), model.coarse(b, j)]
    return model


def texts_of(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most rows labelled documents, those with the smallest hash of their id, held-out ones left out.

    Labels without an id or a value are passed over; an id labelled twice counts with its smaller value. Without usable
    labels the model is a constant.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    some = some.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("double").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # the join's small side has at most rows rows of two numbers
    table = docs.join(F.broadcast(some), docs["doc_id"] == F.col("__id")).select("y", "text", "__id")
    # ids that repeat may join more than rows documents: of those too the smallest hashes stay
    table = table.select("y", "text").mapInArrow(measured, "y double, x array<double>").orderBy(F.xxhash64("x"), "y", "x").limit(rows)
    got = table.orderBy("y", "x").toArrow()
    y = got["y"].to_numpy()
    return fit(np.array(got["x"].to_pylist()).reshape(len(y), len(FEATURES)), y)


def score(docs: DataFrame, model: AdditiveModel, column: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the model's score added; it replaces a column of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.score(features(texts_of(batch.column(text_col)))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, column])

    fields = [f for f in docs.schema if f.name != column]
    names, kept = [f.name for f in fields], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return docs.mapInArrow(run, f"{kept}`{column}` double")


def quality_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: better text) and predicted (1 from 0.5 on) added.

    Each feature of a whole text (FEATURES: shares of kinds of characters, of distinct and repeated words, sizes) is put
    into a bin of a lookup table; tables of features and of chosen pairs of features are boosted in cycles by trees of
    depth two, and a score adds up the looked-up values. Ids, language and source are not looked at. Null text: scored
    as empty; repeated rows get equal scores; an empty table gives an empty result. Other columns pass through; added
    columns replace those of their names.
    """
    out = score(docs, train(docs.select("doc_id", "text"), labels, rows))
    return out.withColumns({"held_out": held_out("doc_id"), "predicted": (F.col("score") >= 0.5).cast("int")})


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")
