"""Linkage operators on small item sets with known clusters."""

import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.operators import linkage, rake
from kindred.operators.linkage import Alike


def edit(a, b):
    return F.levenshtein(a["item"], b["item"])


def number(a, b):
    return F.abs(a["item"].cast("int") - b["item"].cast("int"))


@pytest.fixture
def items(spark):
    return lambda text: spark.createDataFrame(list(enumerate(text.split())), "id long, item string")


def clusters(df, source):
    name, out = {r.id: r.item for r in source.collect()}, {}
    for r in sorted(df.collect()):
        out.setdefault(r.cluster_id, []).append(name[r.id])
    return [sorted(c) for c in out.values()]


def same(got, want):
    assert sorted(got) == sorted(sorted(w.split()) for w in want)


def test_naive(items):
    x = items("abc bcd cde def efg fgh ghi")
    same(clusters(linkage.naive(x, Alike(distance=edit, radius=2)), x), ["abc bcd", "cde bcd def", "efg def fgh", "ghi fgh"])
    x = items("abc abc bde bd bde bcde abcde abcdef abcdefg")
    want = ["abc abc bd abcde", "bde bd bde bcde abcde", "abcdef bcde abcde abcdefg"]
    same(clusters(linkage.naive(x, Alike(distance=edit, radius=2)), x), want)
    same(clusters(linkage.vp_tree(x, edit, 2), x), want)


def test_blocking(items):
    x = items("abc bde bd bde bcde abcde ab")
    near = Alike(distance=edit, radius=1)
    same(clusters(linkage.blocking(x, F.array(F.substring("item", 1, 1)), near), x), ["abc ab", "bde bd bde bcde"])
    same(clusters(linkage.blocking(x, F.split("item", ""), near), x), ["abc ab", "bde bd bde bcde", "abcde bcde"])


def test_canopy_and_leader(items):
    x = items("abc ab bd bde bcde abcde abcdef abcdefg")
    same(clusters(linkage.canopy(x, edit, 2, 1), x), ["abc ab bd abcde", "bd bde bcde", "bcde abcde abcdef", "abcdef abcdefg"])
    for text, want in (("1 2 3 4 10 11 24", ["1 2 3", "4", "10 11", "24"]), ("3 2 1 4 10 11 24", ["3 2 1 4", "10 11", "24"])):
        x = items(text)
        same(clusters(linkage.leader(x, number, 2), x), want)
    x = items("abc abd dbc zyx zxx xxx")
    same(clusters(linkage.leader(x, edit, 1), x), ["abc abd dbc", "zyx zxx", "xxx"])
    with pytest.raises(ValueError):
        linkage.canopy(x, edit, 1, 2)


def test_sorted_neighborhood(items):
    x, near = items("aaa zzz bbb bbb aaa zzz aaz zza"), Alike(distance=edit, radius=1)
    same(clusters(linkage.sorted_neighborhood(x, [[F.asc("item")]], 1, near), x), ["aaa aaa", "zzz zza zzz", "bbb bbb", "aaz aaa"])
    same(clusters(linkage.sorted_neighborhood(x, [[F.asc("item")], [F.desc("item")]], 1, near), x), ["aaa aaa aaz", "zzz zza zzz", "bbb bbb"])


def test_key_collision(spark):
    rows = [(0, "Smith", ["SM0", "XMT"]), (1, "Schmidt", ["XMT", "SMT"]), (2, "Smyth", ["SM0", "XMT"]), (3, "Smit", ["SMT", "XMT"]), (4, "Paul", ["PL"]), (5, "Pol", ["PL"])]
    x = spark.createDataFrame(rows, "id long, item string, keys array<string>")
    assert linkage.key_collision(x, F.col("keys"), "item").count() == 4
    same(clusters(linkage.key_collision_merged(x, F.col("keys")), x), ["Smith Smyth Schmidt Smit", "Paul Pol"])


def test_nn_descent_finds_most_of_the_exact_graph(spark):
    x = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(101)], "id long, v double")
    near = lambda a, b: -F.abs(a["v"] - b["v"])
    exact = {(r.src, r.dst) for r in linkage.exact_knn(x, near, 4).collect()}
    found = {(r.src, r.dst) for r in linkage.nn_descent(x, near, 4, max_iterations=8).collect()}
    assert len(exact & found) / len(exact) > 0.8


def test_alike_needs_a_function():
    with pytest.raises(ValueError):
        Alike()
    with pytest.raises(ValueError):
        Alike(distance=edit, radius="2")


def test_rake(spark):
    docs = spark.createDataFrame([(1, [["deep", "learning", "of", "deep", "nets", ",", "fast", "."]]), (2, [["alone"]])], "doc long, sentences array<array<string>>")
    stops = spark.createDataFrame([("of",)], "word string")
    scores = {(r.doc, r.word): (r.frequency, r.degree) for r in rake.rake_word_scores(rake.rake_words(docs, stops)).collect()}
    assert scores == {(1, "deep"): (2, 2), (1, "learning"): (1, 1), (1, "nets"): (1, 1), (1, "fast"): (1, 0), (2, "alone"): (1, 0)}
    assert [(r.doc, r.rank, r.keyword) for r in rake.rake(docs, stops).collect()] == [(1, 1, ["deep", "learning"])]


def test_rake_ties_to_words(spark):
    """1/10 + 1/5 and 1/4 + 1/20 are equal scores, though not as doubles."""
    last = [["y"] * 9 + ["z"] * 4 + ["a"] * 3 + ["b"] * 19]
    docs = spark.createDataFrame([(1, [["y", "z", "of", "a", "b", "of", "c", "of"], *last])], "doc long, sentences array<array<string>>")
    stops = spark.createDataFrame([("of",)], "word string")
    assert [(r.rank, r.keyword) for r in rake.rake(docs, stops).collect()] == [(1, ["a", "b"])]


def test_rake_punctuation(spark):
    """As RE2 reads it: a word that ends in a carriage return is none, a vertical tab is."""
    words = ["...", "...\r", "\x0b", "\u2026", "\u00e9", "_", "x.", ""]
    docs = spark.createDataFrame([(1, [words])], "doc long, sentences array<array<string>>")
    got = rake.rake_words(docs, spark.createDataFrame([], "word string")).orderBy("pos").collect()
    assert [r.word for r in got if r.stop] == ["...", "\x0b", "\u2026", "\u00e9"]


def test_rake_lower_case(spark, tmp_path):
    spark.createDataFrame([(1, 0, "\u0130zmir of aa\u03a3 of")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.word for r in queries.rake_word_scores(spark, str(tmp_path)).collect()} == {"izmir", "aa\u03c3"}
