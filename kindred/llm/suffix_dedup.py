"""Suffix-array dedup by bucket-pointer refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import ODD, TOP, U, added, added_up, name, slide, without_repeats

GRAM = 8  # bytes of the initial buckets
TILE = 1 << 15  # suffixes at a time, so that steps stay in the processor's cache


def pointers(raw: np.ndarray, begin: int, end: int, depth: int, seed: int) -> np.ndarray:
    """Bucket names of the suffixes from begin to end by their leading depth bytes (a power of two), from q-grams.

    Each step refines the buckets by the bucket of the suffix that starts where the known prefix ends.
    """
    b = np.lib.stride_tricks.sliding_window_view(raw[begin : end + depth], GRAM).copy().view(U).ravel()
    b *= ODD[seed]
    known = GRAM
    while known < depth:
        b, known = name(b[:-known], b[known:]), known * 2
    return b[: end - begin]


class ByteSuffixes:
    """Levels of one block: sampled suffixes, stretches between two of them, and suffixes where stretches end."""

    levels, flag_levels, symbol_bytes = 4, (2,), 6.0

    def __init__(self, length: int):
        self.full, self.half = length, length // 2
        self.depth = GRAM
        while self.depth * 2 <= self.half:
            self.depth *= 2

    def start(self, texts: list[bytes]) -> dict:
        raw = np.frombuffer(b"".join([*texts, bytes(4 * self.depth + GRAM + 2 * self.full)]), np.uint8)
        sizes = np.array([len(x) for x in texts], np.int64)
        n = int(sizes.sum())
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        s = {"raw": raw, "n": n, "sizes": sizes, "room": room, "fits": room >= self.full, "pointers": []}
        d, width, step = self.depth, self.full - self.half + 1, self.half - self.depth
        s["pointers"].append(self.named(s, 0))
        b, grams, least, found = s["pointers"][0], np.empty(n, U), np.empty(n, U), [np.empty(0, np.int64)]
        for p in range(0, n, TILE):
            lo, q = max(0, p - width + 1), min(n, p + TILE)
            hi = min(n, q + width - 1)
            g = name(b[lo:hi], b[lo + step : hi + step])
            g[room[lo:hi] < self.half] = TOP
            m = slide(np.r_[g, np.full(max(0, q + width - 1 - hi), TOP)], width, np.minimum)
            seen = np.where(s["fits"][lo:q], m, U(0))
            most = slide(np.r_[np.zeros(width - 1 - (p - lo), U), seen], width, np.maximum)
            grams[p:q], least[p:q] = g[p - lo : q - lo], m[p - lo :]
            found.append(np.flatnonzero((most == grams[p:q]) & (most > 0)) + p)
        return s | {"grams": grams, "least": least, "anchors": np.concatenate(found)}

    def named(self, s: dict, seed: int) -> np.ndarray:
        out = np.empty(s["n"] + 2 * self.depth + self.full, U)
        for p in range(0, len(out), TILE):
            q = min(len(out), p + TILE)
            out[p:q] = pointers(s["raw"], p, q, self.depth, seed)
        return out

    def refined(self, s: dict, at: np.ndarray) -> list[np.ndarray]:
        """Two names of the buckets of the suffixes at some positions, by as many bytes as a window has."""
        if len(s["pointers"]) == 1:
            s["pointers"].append(self.named(s, 1))
        d, rest = self.depth, self.full - 2 * self.depth
        return [name(name(b[at], b[at + d]), name(b[at + rest], b[at + rest + d])) for b in s["pointers"]]

    def holding(self, s: dict, at: np.ndarray) -> np.ndarray:
        """Where the window that starts here has its least gram at one of some anchors."""
        n, width = s["n"], self.full - self.half + 1
        grams, out = np.full(n + width, TOP), np.empty(n, bool)
        grams[at] = s["grams"][at]
        for p in range(0, n, TILE):
            q = min(n, p + TILE)
            out[p:q] = slide(grams[p : q + width - 1], width, np.minimum) == s["least"][p:q]
        return out & s["fits"]

    def keys(self, s: dict, level: int) -> tuple:
        if level == 0:
            return s["grams"][s["anchors"]], None
        if level == 1:
            a, b = s["stretches"]
            return tuple(name(name(x, y), (b - a).astype(U)) for x, y in zip(self.refined(s, a), self.refined(s, b), strict=True))
        if level == 2:
            grams = s["grams"][s["alive"]]
            return grams, None, np.isin(grams, s["least"][s["asked"] & ~s["known"]])
        return tuple(self.refined(s, s["starts"]))

    def mark(self, s: dict, level: int, repeated: np.ndarray) -> None:
        n = s["n"]
        if level == 0:
            s["alive"] = s["anchors"][repeated]
            s["asked"] = self.holding(s, s["alive"])
            # suffixes that are next to each other among the sampled ones of a document
            a, b = s["anchors"][:-1], s["anchors"][1:]
            ok = repeated[:-1] & repeated[1:] & (b - a <= self.full) & (s["room"][a] - s["room"][b] == b - a) & s["fits"][b]
            s["stretches"] = a[ok], b[ok]
        elif level == 1:
            a, b = (x[repeated] for x in s["stretches"])
            s["known"] = added_up(n, a, b + 1)
        elif level == 2:
            # a suffix that a stretch has settled here may be what an open one elsewhere is equal to
            s["starts"] = np.flatnonzero(self.holding(s, s["alive"][repeated]))
        else:
            s["known"][s["starts"][repeated]] = True
            run = s["known"].astype(np.int8)
            run[self.full :] -= s["known"][: -self.full]
            s["covered"] = np.cumsum(run, dtype=np.int32) > 0

    def finish(self, s: dict, texts: list[bytes]) -> dict[str, pa.Array]:
        gone, cut = s["covered"], np.r_[0, np.cumsum(s["sizes"])]
        first = gone & np.r_[True, ~gone[:-1]] if len(gone) else gone
        begin = cut[:-1][s["sizes"] > 0]
        first[begin] = gone[begin]
        removed, spans = (np.diff(np.r_[0, np.cumsum(x, dtype=np.int32)][cut]) for x in (gone, first))
        keep = ~gone
        kept = [x if not r else s["raw"][a:b][keep[a:b]].tobytes() if r < b - a else b"" for x, a, b, r in zip(texts, cut[:-1], cut[1:], removed, strict=True)]
        return {"__n": pa.array(s["sizes"], pa.int64()), "__removed": pa.array(removed, pa.int64()), "__spans": pa.array(spans, pa.int64()), "__kept": pa.array(kept, pa.binary())}


def suffix_dedup(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """Drop every byte of a text that lies in a string of min_bytes bytes which occurs more than once in the corpus.

    Texts are taken as UTF-8, strings stay inside a document and are judged on the input, so all copies go. The suffixes
    of all texts are put into buckets by a q-gram at first, and buckets are refined by the bucket pointer of a later
    offset, which doubles the known depth each time; a suffix alone in its bucket is done. A bucket pointer is a name
    that follows from the content (128 bits at full depth) instead of a rank, so refining needs no table of all
    suffixes, and a bucket is split over any number of tasks. Only suffixes sampled by content enter at half depth;
    where two neighbours among them are in shared buckets, the stretch between is refined in one step by the pointer of
    the second, and single suffixes are refined only in buckets where such a stretch ends.

    Returns docs with {prefix}n_bytes, {prefix}n_removed, {prefix}n_spans (maximal removed runs) and {prefix}kept_bytes
    (binary: a cut may fall inside a character) added. Null text: empty. Texts shorter than min_bytes stay. Repeated
    rows are separate documents that repeat each other. An empty table gives an empty result. Other columns pass
    through, as long as they do not start with two underscores; added columns replace those of their names. min_bytes must be 16 at least. A block is one task's
    work, so memory follows the longest single text.
    """
    if min_bytes < 2 * GRAM:
        raise ValueError(f"min_bytes must be {2 * GRAM} at least")
    out = without_repeats(docs, ByteSuffixes(min_bytes), "__n long, __removed long, __spans long, __kept binary", id_col, text_col)
    names = {"n_bytes": "__n", "n_removed": "__removed", "n_spans": "__spans", "kept_bytes": "__kept"}
    return added(out, docs.columns, {prefix + k: v for k, v in names.items()})


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
