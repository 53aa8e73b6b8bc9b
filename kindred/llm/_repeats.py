"""What two exact repeat finders share: blocks of documents, and one round of asking which keys occur twice.

Documents are dealt by hash into blocks of about a megabyte and written once, bucketed by block. A round has each
block send the distinct 64 or 128-bit keys that it holds, packed by key range; each range answers with one bit a key:
whether the key occurs more than once anywhere. A key sent by many blocks costs one entry a block, whatever the number
of its copies, so a passage that a third of all documents share stays small. Later rounds build on the answers.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, partitions, text_bytes

U = np.uint64
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 16 << 20
TASK_BYTES = 64 << 20  # text or keys for each bucket of blocks and each task that answers, where shuffle partitions would have more
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
TOP = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a longer string from the names of two strings that cover it, in this order; its high bits are even."""
    out = a >> U(31)
    out ^= a
    out *= ODD[0]
    out += b
    out *= ODD[1]
    return out


def slide(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each width consecutive elements, by doubling."""
    span = 1
    while span * 2 <= width:
        a, span = pick(a[:-span], a[span:]), span * 2
    return pick(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def added_up(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in some half-open interval."""
    return np.cumsum(np.bincount(begin, minlength=n + 1)[:n] - np.bincount(end, minlength=n + 1)[:n]) > 0


def anchors(grams: np.ndarray, fits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least gram of some window of width grams that fits at its start, and each window's least gram.

    Which positions of a window are chosen follows from its content alone, so equal windows share an anchor.
    """
    n = len(grams)
    if n < width:
        return np.empty(0, np.int64), np.full(n, TOP)
    least = np.concatenate([slide(grams, width, np.minimum), np.full(width - 1, TOP)])
    seen = np.where(fits, least, U(0))
    most = slide(np.concatenate([np.zeros(width - 1, U), seen]), width, np.maximum)
    return np.flatnonzero((most == grams) & (most > 0)), least


class Distinct:
    """Keys of one block, each once: high words sorted, low words where there are any, and who holds which."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None, flags: np.ndarray | None = None):
        order = np.argsort(high)
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = high[order][1:] != high[order][:-1]
            if low is not None and (~new[1:] & (low[order][1:] != low[order][:-1])).any():
                order = np.lexsort((low, high))
                new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.high, self.low = high[order][new], None if low is None else low[order][new]
        self.many = np.bincount(self.group, minlength=len(self.high)) > 1 if flags is None else np.bincount(self.group, weights=flags, minlength=len(self.high)) > 0

    def ranges(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Non-empty ranges of the high word out of n, and where each starts (with the end)."""
        at = ((self.high >> U(32)) * U(n) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
        return at[first], np.r_[first, len(at)]

    def send(self, block: int, n: int) -> pa.Table:
        which, cut = self.ranges(n)
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({
            "range": pa.array(which, pa.int64()), "block": pa.array([block] * len(which), pa.int64()),
            "high": pa.array([self.high[a:b].tobytes() for a, b in spans], pa.binary()),
            "low": pa.array([b"" if self.low is None else self.low[a:b].tobytes() for a, b in spans], pa.binary()),
            "many": pa.array([np.packbits(self.many[a:b]).tobytes() for a, b in spans], pa.binary()),
        })

    def repeated(self, answers: Iterable[tuple[int, bytes]], n: int) -> np.ndarray:
        """For each key as it was given: whether it occurs more than once anywhere, or was flagged anywhere."""
        found, (which, cut) = self.many.copy(), self.ranges(n)
        place = {int(w): (a, b) for w, a, b in zip(which, cut[:-1], cut[1:], strict=True)}
        for r, bits in answers:
            a, b = place[r]
            found[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return found[self.group]


SENT = "range long, block long, high binary, low binary, many binary"
ANSWER = "block long, level int, range long, bits binary"


def answer(level: int, flagged_only: bool):
    """Per key range: one bit a key for each block that sent some, for blocks with any repeated (or flagged) key."""

    def find(t: pa.Table) -> pa.Table:
        ranges, blocks = t["range"].to_numpy(), t["block"].to_numpy()
        highs = [np.frombuffer(x, U) for x in t["high"].to_pylist()]
        lows = t["low"].to_pylist()
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)) for m, h in zip(t["many"].to_pylist(), highs, strict=True)]
        d = Distinct(np.concatenate(highs), np.frombuffer(b"".join(lows), U) if any(lows) else None)
        flagged = np.bincount(d.group, weights=np.concatenate(many), minlength=len(d.high)) > 0
        found = (flagged if flagged_only else d.many | flagged)[d.group]
        cut = np.cumsum([0, *map(len, highs)])
        rows = [(blocks[i], ranges[i], np.packbits(f).tobytes()) for i in range(len(highs)) if (f := found[cut[i] : cut[i + 1]]).any()]
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int64()), "level": pa.array([level] * len(rows), pa.int32()),
            "range": pa.array([r[1] for r in rows], pa.int64()), "bits": pa.array([r[2] for r in rows], pa.binary()),
        })

    return find


class Finder(Protocol):
    """One block's work. Keys of a level may depend on the marks of those before; all must follow from the texts."""

    levels: int
    flag_levels: tuple[int, ...]  # those that ask whether any holder of a key has flagged it
    symbol_bytes: float  # about how many bytes of text come to one key at most

    def start(self, texts: list[bytes]): ...
    def keys(self, state, level: int) -> tuple: ...
    def mark(self, state, level: int, repeated: np.ndarray) -> None: ...
    def finish(self, state, texts: list[bytes]) -> dict[str, pa.Array]: ...


def ordered(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The block's rows in an order that follows from its rows alone, and their texts (null: empty)."""
    t = t.sort_by([("__text", "ascending"), ("__id", "ascending")])
    return t, [x or b"" for x in t["__text"].cast(pa.binary()).to_pylist()]


def replay(finder: Finder, t: pa.Table, said: pa.Table | None, upto: int, n: list[int]):
    """The block's state after the answers to the levels before upto."""
    t, texts = ordered(t)
    state = finder.start(texts)
    said = said.to_pylist() if said is not None else []
    for level in range(upto):
        d = Distinct(*finder.keys(state, level))
        finder.mark(state, level, d.repeated(((x["range"], x["bits"]) for x in said if x["level"] == level), n[level]))
    return t, texts, state


def asking(finder: Finder, level: int, n: list[int]):
    """What a block sends at a level: without answers (the first level), and with those to the levels before."""

    def first(t: pa.Table) -> pa.Table:
        return later(t, None)

    def later(t: pa.Table, answers: pa.Table | None) -> pa.Table:
        block = t["__block"][0].as_py() if t.num_rows else 0
        state = replay(finder, t, answers, level, n)[2]
        return Distinct(*finder.keys(state, level)).send(block, n[level])

    return first, later


def added(out: DataFrame, columns: list[str], more: dict[str, str]) -> DataFrame:
    """The columns and more (name: source), which replace those of their names."""
    return out.select(*(out[f"`{c}`"] for c in columns if c not in more), *(F.col(v).alias(k) for k, v in more.items()))


def without_repeats(docs: DataFrame, finder: Finder, schema: str, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns in schema (a DDL list) that finder.finish() gives for each row, one of them kept binary."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = text_bytes(docs, text_col)
    blocks = max(partitions(spark), -(-size // BLOCK_BYTES))
    # each level sends at most a key of 16 bytes for symbol_bytes of text
    sent_bytes = int(size / finder.symbol_bytes * 16)
    n = [max(2 * partitions(spark), sent_bytes // RANGE_BYTES)] * finder.levels
    buckets, tasks = (max(partitions(spark), -(-total // TASK_BYTES)) for total in (size, sent_bytes))
    # equal rows of different input partitions go to different blocks
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(blocks))
    table = scratch.bucketed(docs.select("*", block.alias("__block"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__block", buckets)
    own = table.select("__block", "__id", "__text")
    said = None
    for level in range(finder.levels):
        asked = asking(finder, level, n)
        if said is None:
            sent = own.groupBy("__block").applyInArrow(asked[0], SENT)
        else:
            sent = own.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(asked[1], SENT)
        got = scratch.freeze(sent.repartition(tasks, "range").groupBy("range").applyInArrow(answer(level, level in finder.flag_levels), ANSWER), f"answers{level}")
        said = got if said is None else said.unionByName(got)

    def last(t: pa.Table, answers: pa.Table) -> pa.Table:
        t, texts, state = replay(finder, t, answers, finder.levels, n)
        out = t.drop_columns(["__block", "__id", "__text"])
        for column, values in finder.finish(state, texts).items():
            out = out.append_column(column, values)
        return out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return table.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(last, f"{kept}, {schema}")
