"""Distances of word pairs in blocks against the kernels of single pairs."""

import random

import numpy as np

from kindred import queries
from kindred.functions import sequences
from kindred.operators import word_pairs


def single(a, b):
    return a, b, sequences.lipns(a, b), sequences.mlipns(a, b), float(word_pairs.rounded(sequences.lcs(a, b), 6))


def test_block_distances(spark, monkeypatch):
    """Blocks of one word and of several parts, long words, characters beyond the first plane."""
    draw = random.Random(3)
    monkeypatch.setattr(word_pairs, "PART", 7)
    words = sorted({"".join(draw.choice("abé😀"[: draw.randint(1, 4)]) for _ in range(draw.choice([1, 2, 3, 4, 8, 15, 64, 65, 90]))) for _ in range(80)})
    rows = [(k % 3, w) for k, w in enumerate(words)] + [(9, "alone"), (None, "nowhere"), (None, "never")]
    got = word_pairs.block_distances(spark.createDataFrame(rows, "key int, w string"), "w", ["key"]).collect()
    want = [single(a, b) for k, a in rows for m, b in rows if k == m and k is not None and a < b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_come_in_steps(monkeypatch):
    """A large part makes no list of all its pairs."""
    monkeypatch.setattr(word_pairs, "STEP", 100)
    steps = list(word_pairs.pairs_of(np.array([50, 1, 3]), np.array([0, 0, 2]), np.array([0, 50, 51])))
    assert max(len(a) for a, _ in steps) <= 100
    assert [(i, j) for a, b in steps for i, j in zip(a.tolist(), b.tolist(), strict=True)] == [(i, j) for i in range(50) for j in range(i + 1, 50)] + [(i, j) for i in (51, 52, 53) for j in (54, 55)]


def test_many_characters_need_wider_codes():
    words = ["".join(map(chr, range(0x4E00 + k, 0x4E00 + k + 20))) for k in range(0, 600, 10)]
    codes, _ = word_pairs.coded(words)
    assert codes.dtype == np.uint32
    agree, run = word_pairs.compared(codes[:-1].T.copy(), codes[1:].T.copy())
    assert set(agree.tolist()) == {0} and set(run.tolist()) == {10}


def test_words_are_lowered_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "İzmiré aaİxx abcΣΑΣ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.b for r in queries.word_distances(spark, str(tmp_path)).collect()} == {"izmiré", "aaixx", "abcσασ"}
