"""SentencePiece encoding and decoding by Viterbi over words that share prefixes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the format: an unknown character scores this much below the worst piece
CACHE = 300_000  # words whose pieces a worker keeps


def pack_id(i: int) -> bytes:
    return i.to_bytes(4, "little")


class Pieces:
    """The pieces and scores in a SentencePiece model file, and the best segmentations under them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.piece_size())
        self.names = [model.id_to_piece(i) for i in every]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in every if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.unknown = model.unk_id()
        silent = {i for i in every if model.is_control(i)}
        self.said = ["" if i in silent else " ⁇ " if i == self.unknown else n.replace(MARK, " ") for i, n in enumerate(self.names)]
        plain = [i for i in every if not (i in silent or i in self.byte_of or i == self.unknown or model.is_unused(i))]
        self.scores = {self.names[i]: (model.get_score(i), i) for i in plain}
        self.packed = {p: pack_id(i) for p, (_, i) in self.scores.items()}
        # every ending of a piece, with its score if it is a piece itself
        self.tails = {p[k:]: -math.inf for p in self.scores for k in range(len(p))} | {p: s for p, (s, _) in self.scores.items()}
        self.floor = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        # where no piece goes on, a text can be cut without changing its best segmentation
        joined = {c for p in self.scores if len(p) > 1 for c in p} - {MARK}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        inner = "".join(re.escape(c) for c in sorted(joined | ({MARK} if crossing else set())))
        self.words = re.compile(f"{MARK}*[{inner}]+|{MARK}+|." if not crossing else f"[{inner}]+|.", re.S)
        # ids of a word as little-endian 32-bit numbers
        self.cache: dict[str, bytes] = {}

    def ids_of(self, piece: str) -> bytes:
        known = self.packed.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            known = b"".join(pack_id(self.byte_ids[b]) for b in raw) if self.byte_ids else pack_id(self.unknown)
        return known

    def learn(self, words: set[str]) -> None:
        """Segment words that are not known yet: in sorted order they run through a trie depth-first, and the forward
        scores up to the prefix that a word shares with the one before it are still there."""
        ending, whole, floor, ids_of, cache = self.tails.get, self.packed.get, self.floor, self.ids_of, self.cache
        best, back, before = [0.0], [0], ""
        for word in sorted(words):
            shared, size = 0, len(word)
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, size + 1):
                begin = start = end - 1
                top = best[begin] + floor
                # backwards as long as some piece ends like this
                while begin >= 0 and (score := ending(word[begin:end])) is not None:
                    if (sum_ := best[begin] + score) > top:
                        top, start = sum_, begin
                    begin -= 1
                best.append(top)
                back.append(start)
            ids = b""
            while size:
                piece = word[back[size] : size]
                ids = (whole(piece) or ids_of(piece)) + ids
                size = back[size]
            cache[word] = ids
            before = word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*split)
        self.learn(new)
        known = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), "<i4") for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; only bytes that are not UTF-8, which no encoding makes, come back as U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.said.__getitem__, ids))
        else:
            parts = (bytes([self.byte_of[i]]) if i in self.byte_of else self.said[i].encode("utf-8", "surrogatepass") for i in ids)
            text = b"".join(parts).decode("utf-8", "replace")
        return text.removeprefix(" ")


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


PORTION = 2 << 20  # characters that are segmented at a time: more words share more prefixes


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", column: str = "ids") -> DataFrame:
    """docs with the ids of each text's best segmentation into the pieces of a SentencePiece model.

    model is the path of the model file, which each executor must have. Spaces become marks, with one before the text,
    and no other normalisation is done. Of all segmentations into pieces the one with the largest sum of scores is
    taken; characters that no piece covers become bytes, where the model has them, or the unknown id. A text is cut
    into marked words where no piece can go on; a task's distinct words are sorted and segmented in one walk through
    their trie, in which words share the forward scores of common prefixes. This is how a unigram model segments; a
    model trained as BPE gives its scores, not its merges.

    Null text: null ids. Empty text: no ids. Repeated rows get equal ids; an empty table gives an empty result. Other
    columns pass through; column replaces one of its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts, ids, at = batch.column(text_col).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < PORTION:
                    size += len(texts[end] or "")
                    end += 1
                got = own.encode([t or "" for t in texts[at:end]])
                ids += [None if t is None else g for t, g in zip(texts[at:end], got, strict=True)]
                at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))], [*names, column])

    kept = [f for f in docs.schema if f.name != column]
    names = [f.name for f in kept]
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{column}` array<int>")


def decode_pieces(docs: DataFrame, model: str, ids_col: str = "ids", column: str = "decoded") -> DataFrame:
    """docs with the text that ids stand for: what was encoded, except that a literal U+2581 comes back as a space.

    Null ids: null text. No ids: empty text. Other columns pass through; column replaces one of its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            ids = batch.column(ids_col)
            # a row's ids become Python numbers only while it is decoded
            numbers, cut = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [own.decode(numbers[a:b].tolist()) if ok else None for a, b, ok in zip(cut, cut[1:], ids.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, column])

    kept = [f for f in docs.schema if f.name != column]
    names = [f.name for f in kept]
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{column}` string")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = path("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(docs, model), model)
    digest = F.xxhash64("ids")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("same"))
