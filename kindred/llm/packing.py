"""Packing documents into token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, partitions

END_ID = 1
BLOCK_WINDOWS = 256  # windows that one task balances at a time
BUNDLE = 32  # smaller pieces than this part of a window are balanced in lots, so that a block has few items
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __salt long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it prints, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """The tiktoken encoding that gives the ids of a tokenizer file, or None if the file asks for more than it can do.

    It can do byte-level BPE whose merges come in the order of their ids, on whole texts (no normaliser, no prefix
    space), with added tokens that match anywhere as they are.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before, letters = file["model"], file.get("pre_tokenizer") or {}, byte_letters()
    plain = not any(file.get(k) for k in ("normalizer", "truncation", "padding"))
    plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    plain &= not any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    plain &= all(t["special"] or not t["normalized"] for t in file["added_tokens"])
    if not plain:
        return None
    vocabulary, special = model["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    order = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(x >= y for x, y in zip(order, order[1:])) or not vocabulary.keys() >= letters.keys() or not all(set(t) <= letters.keys() for t in vocabulary.keys() - special.keys()):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    # Fixed value: the pattern that the byte-level pre-tokenizer splits by.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """From a text to its ids under a file of the tokenizers library: by tiktoken, four times as fast, where the file
    allows it, else by the library itself."""
    if fast := ranked(path):
        return lambda text: fast.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: list(tokenizer.encode(text, add_special_tokens=False).ids)


def bundled(sizes: list[int], least: int) -> list[list[int]]:
    """The items in lots: those of least and more alone, smaller ones together, least to twice as much at a time."""
    lots, small, held = [], [], 0
    for i, size in enumerate(sizes):
        if size >= least:
            lots.append([i])
            continue
        small.append(i)
        held += size
        if held >= least:
            lots.append(small)
            small, held = [], 0
    return [*lots, small] if small else lots


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: which items go to each of some windows, so that the windows' sums are nearly equal.

    Every item starts as a partition of its own with one filled window. The two partitions with the largest spread are
    merged, the fullest windows of one with the emptiest of the other, until one is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int32), np.full(windows, -1, np.int32)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    left, right, made = [], [], len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, order, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        nodes = np.maximum(x, y)
        left.append(x[both])
        right.append(y[both])
        nodes[both] = np.arange(made, made + len(both))
        made += len(both)
        by = np.argsort(-sums, kind="stable")
        sums = sums[by] - sums[by[-1]]
        heapq.heappush(heap, (-int(sums[0]), order, sums, nodes[by]))
    left, right = (np.concatenate(z).tolist() if z else [] for z in (left, right))
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node] if node >= 0 else []
        while stack:
            k = stack.pop()
            if k < len(sizes):
                items.append(k)
            else:
                stack += (left[k - len(sizes)], right[k - len(sizes)])
        out.append(items)
    return out


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within capacity: as few as the sum needs, and more while the fullest is over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    lots = bundled(sizes, max(1, capacity // BUNDLE))
    held = [sum(sizes[i] for i in lot) for lot in lots]
    while True:
        out = [[i for k in w for i in lots[k]] for w in difference(held, windows) if w]
        worst = max((sum(sizes[i] for i in w) for w in out), default=0)
        if worst <= capacity:
            return out
        windows += max(1, windows * (worst - capacity) // (4 * capacity))


def cut(total: int, capacity: int, piece: int) -> list[int]:
    """Lengths of a document's pieces: full sequences first, then pieces small enough to balance well."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [piece] * (rest // piece) + ([rest % piece] if rest % piece else [])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, piece: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into sequences of at most capacity tokens with little padding.

    A document is its text's ids (null text: none) and the id END_ID. Whole sequences are cut off first; what remains is
    cut into pieces of at most piece tokens. Pieces are dealt evenly into blocks that fill some hundred sequences each,
    and a block balances its pieces over its sequences by Karmarkar-Karp differencing, the smallest pieces in lots.
    tokenizer is the path of a file for the tokenizers library, which each executor must have; texts are encoded as that
    library does, special tokens' strings included.

    Returns one row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id, offset (in the sequence, gapless from 0). Empty texts are
    one piece of one id; repeated rows are packed once each; an empty table gives an empty result; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        salt = TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "")
                ids.append(END_ID)
                raw, start = np.array(ids, "<u4").tobytes(), 0
                for length in cut(len(ids), capacity, piece):
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids), salt))
                    start, salt = start + length, salt + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__salt"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = scratch.freeze(source.mapInArrow(pieces, PIECE), "pieces")
    short = F.col("length") < capacity
    tokens, full = table.agg(F.sum(F.when(short, F.col("length"))), F.count(F.when(~short, 1))).first()
    blocks = max(1, -(-(tokens or 0) // (capacity * BLOCK_WINDOWS)), -(-full // (16 * BLOCK_WINDOWS)))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by("__salt")
        sizes = t["length"].to_pylist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        small = [i for i, s in enumerate(sizes) if s < capacity]
        windows = [[small[i] for i in w] for w in balanced([sizes[i] for i in small], capacity)] if small else []
        windows += [[i] for i, s in enumerate(sizes) if s == capacity]
        base = t["__block"][0].as_py() << 32 if sizes else 0
        for k, w in enumerate(windows):
            at = 0
            for i in w:
                sequence[i], offset[i] = base + k, at
                at += sizes[i]
        return t.drop_columns(["__salt", "__block"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = table.withColumn("__block", F.pmod("__salt", F.lit(blocks)))
    return dealt.repartition(partitions(spark), "__block").groupBy("__block").applyInArrow(place, PLACED)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"))
