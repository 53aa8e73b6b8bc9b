"""Substring dedup, suffix dedup and near-dedup against brute force."""

import pytest

from kindred.llm.minhash_dedup import minhash_dedup, near_classes
from kindred.llm.substring_dedup import substring_dedup
from kindred.llm.suffix_dedup import suffix_dedup

from . import helpers as H


@pytest.mark.parametrize("size", [4, 9, 35])
def test_substring_dedup(spark, size):
    rows = H.corpus(1)
    got = substring_dedup(spark.createDataFrame(rows, H.SCHEMA), size, prefix="x_").select("doc_id", "x_n_words", "x_n_removed", "x_kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(H.substring_dedup(rows, size), key=str)


@pytest.mark.parametrize("size", [16, 50, 200])
def test_suffix_dedup(spark, size):
    rows = H.corpus(2)
    out = suffix_dedup(spark.createDataFrame(rows, H.SCHEMA), size)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(H.suffix_dedup(rows, size), key=str)
    assert out.columns[:4] == ["doc_id", "text", "lang", "n_words"]


def test_suffix_copies_settled_elsewhere(spark):
    """A window that a longer shared stretch settles in two texts must still count for a third that shares less."""
    import random

    draw = random.Random(5)
    text = "".join(draw.choices("abcdefgh ", k=900))
    rows = [(1, text, "", 0), (2, text, "", 0), (3, "".join(draw.choices("ijkl", k=300)) + text[400:640] + "".join(draw.choices("mnop", k=300)), "", 0)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup(spark.createDataFrame(rows, H.SCHEMA), 200).collect()]
    assert sorted(got) == sorted(H.suffix_dedup(rows, 200))


@pytest.mark.parametrize("size", [2, 5])
def test_near_classes(spark, size):
    rows = H.corpus(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_classes(spark.createDataFrame(rows, H.SCHEMA), 80, size).collect()}
    assert got == H.components(rows, 80, size)


def test_near_copies_of_one_base(spark):
    """Copies that are alike to their base but not to each other are one group."""
    import random

    draw = random.Random(7)
    base = ["w%d" % draw.randrange(10_000) for _ in range(150)]
    rows = [(0, " ".join(base), "", 0)]
    for i in range(1, 120):
        copy = list(base)
        for k in draw.sample(range(150), 8):
            copy[k] = f"c{i}_{k}"
        rows.append((i, " ".join(copy), "", 0))
    got = {r.id: (r.n_shingles, r.component_id) for r in near_classes(spark.createDataFrame(rows, H.SCHEMA), 80, 2).collect()}
    assert got == H.components(rows, 80, 2)


def test_links_in_dense_regions(spark, monkeypatch):
    """Pairs at exactly 0.8 among many that share prefixes with them are linked, in regions of more than one tile."""
    import random

    from kindred.llm import minhash_dedup as module

    monkeypatch.setattr(module, "DENSE", 8)
    draw = random.Random(11)
    words = {f"w{i}" for i in range(215)}
    rows = []
    for i in range(120):
        one = set(draw.sample(sorted(words), 180))
        two = one - set(draw.sample(sorted(one), 20)) | set(draw.sample(sorted(words - one), 20))
        rows += [(2 * i, " ".join(sorted(one)), "", 0), (2 * i + 1, " ".join(sorted(two)), "", 0)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_classes(spark.createDataFrame(rows, H.SCHEMA), 80, 1).collect()}
    assert got == H.components(rows, 80, 1)


def test_links_in_a_region_above_its_bound(spark):
    """Pairs at 0.80 to 0.82 are linked where regions hold more members than one tile."""
    import random

    import numpy as np

    from kindred.llm import minhash_dedup as module

    draw, n = random.Random(13), 2600
    words = range(206)
    sets = []
    for _ in range(n // 2):
        one = set(draw.sample(words, 178))
        k = draw.choice([18, 19])
        sets += [one, one - set(draw.sample(sorted(one), k)) | set(draw.sample(sorted(set(words) - one), k))]
    x = np.zeros((n, 206), np.float32)
    for i, s in enumerate(sets):
        x[i, list(s)] = 1
    # twenty words that only the two of a pair share
    rows = [(i, " ".join(sorted([*(f"w{k}" for k in s), *(f"own{i // 2}_{k}" for k in range(20))])), "", 0) for i, s in enumerate(sets)]
    both = x @ x.T + 20 * (np.arange(n)[:, None] // 2 == np.arange(n) // 2)
    linked = 100 * both >= 80 * (2 * 198 - both)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        low, high = sorted((find(i), find(j)))
        root[high] = low
    docs = spark.createDataFrame(rows, H.SCHEMA)
    labels = docs.selectExpr("doc_id AS id", "text").mapInArrow(module.sketched(1), "id long, n long, key_a long, key_b long, sig binary").select("id", "n", "sig").mapInArrow(module.labelled, module.LABELS)
    assert labels.groupBy("p6").count().agg({"count": "max"}).first()[0] > module.DENSE
    got = {r.id: r.component_id for r in near_classes(docs, 80, 1).collect()}
    assert got == {i: find(i) for i in range(n)}


def test_signatures_that_agree_less():
    """A pair whose signatures agree in two thirds of their values is left to its names, from its first tree."""
    import numpy as np
    import pyarrow as pa

    from kindred.llm.minhash_dedup import promising

    one = np.arange(240, dtype=np.uint16)
    two = np.where(np.arange(240) < 160, one, one + 1000).astype(np.uint16)
    for shared, tree, want in ((90, 0, 1), (90, 1, 0), (80, 0, 0)):
        low = [np.arange(100, dtype=np.uint32).tobytes(), np.arange(100 - shared, 200 - shared, dtype=np.uint32).tobytes()]
        t = pa.table({"id": [1, 2], "n": [100, 100], "comp": [1, 2], "tile": [0, 0], "tree": [tree] * 2, "sig": [one.tobytes(), two.tobytes()], "low": low})
        assert promising(80)((pa.scalar(7), pa.scalar(0), pa.scalar(0)), t).num_rows == want


def test_least_names_lose_no_link():
    """Pairs of sets at 0.8 and more pass, whatever their sizes; small sets below 0.78 do not."""
    import numpy as np

    from kindred.llm import minhash_dedup as module

    draw = np.random.default_rng(5)
    sets, pairs, alike = [], [], []
    for size in (1, 5, 90, 200, 256, 257, 400, 3000):
        for share in (0.5, 0.7, 0.8, 0.85, 1.0):
            for _ in range(20):
                both = int(np.ceil(2 * size * share / (1 + share)))
                names = draw.choice(1 << 32, 2 * size - both, replace=False).astype(np.uint32)
                pairs.append((len(sets), len(sets) + 1))
                alike.append(both / (2 * size - both))
                sets += [names[:size], names[size - both :]]
    low, n = [np.sort(s)[: module.LEAST] for s in sets], np.array([len(s) for s in sets])
    x, y = np.array(pairs).T
    equal = np.random.default_rng(6).binomial(240, alike)
    got = module.likely(80, low, n, x, y, equal, 240)
    alike = np.array(alike)
    assert got[alike >= 0.8].all() and not got[(alike < 0.78) & (n[x] > 90) & (n[x] <= 256)].any() and not got[alike < 0.6].any()


def test_kept_documents(spark):
    rows = H.corpus(4)
    found = H.components(rows, 80, 5)
    out = minhash_dedup(spark.createDataFrame(rows, H.SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "n_words"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((d for d, *_ in rows if d is None or found[d][1] == d), key=str)


@pytest.mark.parametrize("run", [lambda d: substring_dedup(d, prefix="x_"), suffix_dedup, minhash_dedup, near_classes])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], H.SCHEMA)).count() == 0


def test_added_columns_replace_those_of_their_names(spark):
    from kindred.llm.quality import quality_classifier
    from kindred.llm.url_filters import RULES, url_filters

    docs = spark.createDataFrame([(1, "a b", "old", "old", 7.0), (2, None, "old", "old", 7.0)], "doc_id long, text string, n_words string, n_bytes string, score double")
    assert substring_dedup(docs).orderBy("doc_id").select("n_words").collect() == [(2,), (0,)]
    assert suffix_dedup(docs).orderBy("doc_id").select("n_bytes").collect() == [(3,), (0,)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier(docs, labels).collect()} != {7.0}
    pages = spark.createDataFrame([(1, "http://a.net/", "old", "old")], "page_id long, url string, host string, verdict string")
    assert url_filters(pages, RULES).select("host", "verdict").collect() == [("a.net", "block")]


def test_equal_rows_in_many_partitions(spark):
    """Rows that repeat row for row are dealt over blocks, and still repeat each other."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text)] * 200 + [(2, "short one")], "doc_id long, text string").repartition(8)
    got = substring_dedup(docs).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 40, 200), (2, 0, 1)]


def test_bad_parameters(spark):
    docs = spark.createDataFrame([], H.SCHEMA)
    with pytest.raises(ValueError):
        substring_dedup(docs, 3)
    with pytest.raises(ValueError):
        suffix_dedup(docs, 10)


def test_components_grow(spark):
    """Links in two lots give the groups that all of them give at once, chains and hubs included."""
    import random

    from kindred.llm._shared import Scratch
    from kindred.llm.minhash_dedup import components

    draw = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    draw.shuffle(links)
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    scratch = Scratch(spark)
    lots = [spark.createDataFrame([p for p in lot if p[0] != p[1]], "a long, b long") for lot in (links[:60], links[60:])]
    known = components(scratch, lots[0], "one")
    got = {r.id: r.comp for r in components(scratch, lots[1], "two", known).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    none = components(scratch, lots[0].limit(0), "none")
    assert none.count() == 0 and components(scratch, lots[0].limit(0), "still", known).count() == known.count()
