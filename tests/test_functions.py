"""Column functions on values with known results."""

import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import hashes, keyers, metrics, sequences, text, tokens, vectors
from kindred.operators import frequencies
from kindred.sources import parsers


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def pair(spark, a, b, column, kind="string"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(column.alias("r")).first().r


PAIRS = [
    (lambda: metrics.levenshtein("a", "b"), "book", "back", 2), (lambda: sequences.damerau_levenshtein_column("a", "b"), "sUzSOwx", "zsSxUwO", 6), (lambda: sequences.damerau_levenshtein_column("a", "b"), "ca", "abc", 3),
    (lambda: metrics.lig2("a", "b"), "Glavin", "Glawyn", 2 / 3), (lambda: metrics.lig3("a", "b"), "Glavin", "Glawyn", 0.8), (lambda: sequences.jaro_column("a", "b"), "Dwayne", "Duane", 0.8222), (lambda: sequences.jaro_winkler_column("a", "b"), "Dwayne", "Duane", 0.84),
    (lambda: sequences.lcs_column("a", "b"), "chat", "cat", 0.5), (lambda: sequences.smith_waterman_column("a", "b", gap=1.4, match=1.5, mismatch=0.5), "GCATAGCU", "GATTACA", 6.5),
    (lambda: sequences.sift4_column("a", "b"), "levenshtein", "frankenstein", 10), (lambda: sequences.sift4_column("a", "b", transpositions=True), "levenshtein", "frankenstein", 6),
    (lambda: sequences.sift4_column("a", "b", transpositions=True, max_offset=2), "levenshtein", "frankenstein", 7), (lambda: sequences.sift4_column("a", "b", transpositions=True, max_offset=1), "levenshtein", "frankenstein", 12),
    (lambda: metrics.jaccard("a", "b"), "", "", 1), (lambda: metrics.jaccard("a", "b"), "a", "", 0), (lambda: metrics.overlap("a", "b"), "abc", "abcd", 1), (lambda: metrics.bag("a", "b"), "aab", "abb", 1), (lambda: metrics.identity_distance("a", "b"), "a", "b", 1),
]


@pytest.mark.parametrize("column, a, b, want", PAIRS)
def test_pairs(spark, column, a, b, want):
    assert pair(spark, a, b, column()) == pytest.approx(want, abs=0.001)


def test_nulls_and_nan(spark):
    assert pair(spark, None, "a", sequences.jaro_column("a", "b")) is None
    assert pair(spark, None, "a", metrics.jaccard("a", "b")) is None
    assert math.isnan(pair(spark, "", "", metrics.tversky("a", "b")))
    assert math.isnan(pair(spark, [0.0], [0.0], vectors.cosine("a", "b"), "array<double>"))
    assert pair(spark, "kitten", "sitting", metrics.levenshtein_limited(2, "a", "b")) == math.inf


def test_arrays(spark):
    a, b = ["the", "cat", "eats", "mouse"], ["the", "mouse", "likes", "mouse"]
    kind = "array<string>"
    assert pair(spark, a, b, sequences.levenshtein_column("a", "b"), kind) == 2
    assert pair(spark, a, b, metrics.jaccard("a", "b", array=True), kind) == pytest.approx(2 / 5)
    assert pair(spark, "John Smith".split(), "Samuel John Chapman".split(), metrics.monge_elkan_symmetric(metrics.identity_similarity, "a", "b"), kind) == pytest.approx(0.4166667)


def test_mra(spark):
    got = pair(spark, "Byrne", "Boern", sequences.mra_column("a", "b"))
    assert (got.codex, got.minimum, got.similarity, got.matching) == (["BYRN", "BRN"], 4, 5, True)


def test_errors(spark):
    with pytest.raises(Exception, match="unequal length"):
        pair(spark, "ab", "abc", metrics.hamming("a", "b"))
    with pytest.raises(Exception, match="unequal dimension"):
        pair(spark, [1.0], [1.0, 2.0], vectors.euclidean("a", "b"), "array<double>")
    for bad in (lambda: metrics.tversky("a", "b", alpha=-1), lambda: vectors.minkowski(0.5, "a", "b"), lambda: metrics.ngrams("a", 0), lambda: tokens.skipgrams("a", 2, 1), lambda: sequences.jaro_winkler_column("a", "b", scaling_factor=0.3), lambda: text.translation("a", "ab", "c")):
        with pytest.raises(ValueError):
            bad()


def test_keys(spark):
    assert one(spark, "Christopher", keyers.omission("v")) == "PHCTSRIOE"
    assert one(spark, "Christopher", keyers.skeleton("v")) == "CHRSTPIOE"
    assert one(spark, "é Oh", keyers.normalize("v")) == "e oh"
    assert one(spark, "é Oh", keyers.normalize("v", keep_case=True)) == "e Oh"
    assert one(spark, "é Oh", keyers.normalize("v", keep_accents=True)) == "é oh"
    assert one(spark, "PariS", keyers.ngrams_fingerprint("v", 3)) == "ariparris"
    sets = one(spark, "J.R.R. Tolkien", keyers.name_power_set("v"))
    assert sorted(sets) == sorted([["J", "R", "Tolkien"], ["J", "Tolkien"], ["R", "Tolkien"]])


def test_texts(spark):
    assert one(spark, "Æsir þorn Łódź ßø ĳ", text.deburr("v")) == "Aesir thorn Lodz sso ij"
    assert one(spark, "aabbbc", text.squeeze("v")) == "abc"
    assert one(spark, ["a", "a", None, None, "b"], text.squeeze_array("v"), "array<string>") == ["a", None, "b"]
    assert one(spark, "a.b", text.fuzzy_pattern("v")) == r"(a).*?(\.).*?(b)"
    assert one(spark, "x1y22", text.findall("v", r"\d+")) == ["1", "22"]
    assert one(spark, "aXbXc", text.replaced("v", "(X)", "<$1>", once=True)) == "a<X>bXc"
    assert one(spark, "abcd", F.transform(tokens.skipgrams(text.chars("v"), 1, 2), lambda g: F.array_join(g, ""))) == ["ab", "ac", "bc", "bd", "cd"]


def test_crc32_and_minhash(spark):
    assert one(spark, "ßø⊂", hashes.crc32("v")) == -1838769021
    pairs = hashes.coefficients(64)
    same = metrics.minhash_similarity(hashes.minhash("a", pairs), hashes.minhash("b", pairs))
    assert pair(spark, "abc", "abc", same) == 1 and pair(spark, "", "", same) == 1 and pair(spark, "abc", "def", same) == 0


def test_parsers(spark):
    got = one(spark, "Austin/np-hl ,/,-hl Texas/np-hl\n\tthe/at", parsers.brown("v"))
    assert [(t.word, t.tag) for t in got] == [("Austin", "np-hl"), (",", ",-hl"), ("Texas", "np-hl"), ("the", "at")]
    got = one(spark, "Confidence NN B-NP\nin IN B-PP\n\n\nChancellor NNP O\n", parsers.conll("v"))
    assert [[tuple(t) for t in s] for s in got] == [[("Confidence", "NN", "B-NP"), ("in", "IN", "B-PP")], [("Chancellor", "NNP", "O")]]
    assert one(spark, "<h1>Hello</h1><b>World</b>!<!-- no --><script>x<y</script> &amp; more", parsers.html_text("v")) == "HelloWorld! & more"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the/at cat/nn")
    assert [(r.word, r.tag) for r in parsers.read_brown(spark, str(tmp_path / "a.txt")).collect()] == [("the", "at"), ("cat", "nn")]
    (tmp_path / "b.txt").write_text("a B C\n\nd E F\n")
    assert [(r.sentence, r.pos, r.word, r.tag, r.chunk) for r in parsers.read_conll(spark, str(tmp_path / "b.txt")).collect()] == [(0, 0, "a", "B", "C"), (1, 0, "d", "E", "F")]


def test_row_frequencies(spark):
    assert one(spark, ["t", "e", "s", "t"], frequencies.row_relative("v"), "array<string>") == {"t": 0.5, "e": 0.25, "s": 0.25}
    both = pair(spark, {"a": 1}, {"a": 2, "b": 1}, frequencies.row_updated("a", "b"), "map<string,bigint>")
    assert both == {"a": 3, "b": 1}
