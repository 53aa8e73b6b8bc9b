"""Substring dedup by level-wise doubling."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import U, added, added_up, anchors, mix, name, without_repeats

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SEEDS = tuple(mix(np.arange(256, dtype=U) + U(k << 32)) for k in (1, 2))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PIECE = 1 << 18


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(n, 0xC6A4A7935BD1E995, U))])


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit names for each word of all texts, one after the other, and the number of words of each text."""
    parts, counts = ([], []), np.zeros(len(texts), np.int64)
    batch: list[bytes] = []

    def flush() -> None:
        raw = np.frombuffer(b"\n".join([b"", *batch, b""]), np.uint8)
        gap = SPACE[raw]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        if len(starts):
            ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
            size = ends - starts
            inside = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
            power, body, dead = powers(int(size.max())), raw[starts[0] :], gap[starts[0] :]
            weight = power[np.minimum(inside, len(power) - 1)]
            weight[dead] = 0
            for seed, out in zip(SEEDS, parts, strict=True):
                out.append(mix(np.add.reduceat(seed[body] * weight, starts - starts[0]) + size.astype(U)))
        at = np.cumsum([0, *(len(x) + 1 for x in batch)])
        counts[done : done + len(batch)] = np.diff(np.searchsorted(starts, at + 1))
        batch.clear()

    done = size = 0
    for i, x in enumerate(texts):
        batch.append(x)
        size += len(x)
        if size >= PIECE or i == len(texts) - 1:
            flush()
            done, size = i + 1, 0
    return *(np.concatenate(p) if p else np.empty(0, U) for p in parts), counts


def doubled(names: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of length names, built from windows half as long; the last ones run past the end."""
    span, a = 1, names
    while span < length:
        step = min(span, length - span)
        a, span = name(a[:-step], a[step:]) if len(a) > step else a[:0], span + step
    return np.concatenate([mix(a), np.zeros(len(names) - len(a), U)])


class WordWindows:
    """Levels of one block: sampled windows of a quarter, windows of half and of the full number of words."""

    levels, flag_levels, symbol_bytes = 3, (), 5.0

    def __init__(self, words: int):
        self.full = words
        self.half = (words + 1) // 2
        self.base = (self.half + 1) // 2

    def start(self, texts: list[bytes]) -> dict:
        high, low, counts = word_names(texts)
        ends = np.repeat(np.cumsum(counts), counts)
        room = ends - np.arange(len(ends))
        grams = np.where(room >= self.base, doubled(high, self.base), ~U(0))
        found, _ = anchors(grams, room >= self.full, self.full - self.base + 1)
        return {"high": high, "low": low, "counts": counts, "room": room, "grams": grams, "anchors": found}

    def keys(self, s: dict, level: int) -> tuple[np.ndarray, np.ndarray | None]:
        if level == 0:
            return s["grams"][s["anchors"]], None
        if level == 1:
            return doubled(s["high"], self.half)[s["halves"]], None
        full = s["starts"]
        return doubled(s["high"], self.full)[full], doubled(s["low"], self.full)[full]

    def mark(self, s: dict, level: int, repeated: np.ndarray) -> None:
        n = len(s["room"])
        if level == 0:
            # twice as long to either side; a full window around the anchor holds one of the two whole
            a = s["anchors"][repeated]
            back = a - (self.half - self.base)
            inside = (back >= 0) & (s["room"][np.maximum(back, 0)] - s["room"][a] == a - back)
            halves = np.unique(np.concatenate([a, back[inside]]))
            s["halves"] = halves[s["room"][halves] >= self.half]
        elif level == 1:
            h = s["halves"][repeated]
            near = added_up(n, np.maximum(h - (self.full - self.half), 0), h + 1)
            s["starts"] = np.flatnonzero(near & (s["room"] >= self.full))
        else:
            at = s["starts"][repeated]
            s["covered"] = added_up(n, at, at + self.full)

    def finish(self, s: dict, texts: list[bytes]) -> dict[str, pa.Array]:
        cut = np.r_[0, np.cumsum(s["counts"])]
        removed = np.diff(np.r_[0, np.cumsum(s["covered"])][cut])
        kept = []
        for i, x in enumerate(texts):
            words = WORD.findall(x)
            if removed[i]:
                words = [w for w, gone in zip(words, s["covered"][cut[i] : cut[i + 1]].tolist(), strict=True) if not gone]
            kept.append(b" ".join(words))
        return {"__n": pa.array(s["counts"], pa.int64()), "__removed": pa.array(removed, pa.int64()), "__kept": pa.array(kept, pa.binary()).cast(pa.string())}


def substring_dedup(docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """Drop every word that lies in a window of min_words words which occurs more than once in the corpus.

    Words are runs of anything but space and \\t\\n\\v\\f\\r; windows stay inside a document and are judged on the input,
    so all copies of a passage go. Level-wise: windows of a quarter of the length, sampled so that equal full windows
    share one, are counted over the corpus; only those that occur twice are extended to twice that length and counted
    again; what survives is extended to the full length, whose windows are compared by 128-bit names. A length at which
    nothing survives ends it, since no longer window can repeat.

    Returns docs with {prefix}n_words, {prefix}n_removed and {prefix}kept_text (words joined by one space) added. Null
    text: no words, empty kept text. Fewer words than min_words: kept. Repeated rows are separate documents that repeat
    each other. An empty table gives an empty result. Other columns pass through, as long as they do not start with two
    underscores; added columns replace those of their names. min_words must be 4 at least. A block is one task's work, so memory follows the
    longest single text.
    """
    if min_words < 4:
        raise ValueError("min_words must be 4 at least")
    out = without_repeats(docs, WordWindows(min_words), "__n long, __removed long, __kept string", id_col, text_col)
    return added(out, docs.columns, {f"{prefix}n_words": "__n", f"{prefix}n_removed": "__removed", f"{prefix}kept_text": "__kept"})


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
