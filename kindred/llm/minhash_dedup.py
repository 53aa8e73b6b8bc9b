"""MinHash near-dedup by an LSH forest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._repeats import U, mix, name
from ._shared import Scratch, gathered, partitions, portions
from .quality import texts_of
from .substring_dedup import word_names

TREES, DEPTH = 40, 6  # a pair at a similarity of 0.8 shares no prefix of DEPTH values in any tree once in 200,000 times
TILE = 256  # members of a region that are compared with as many at a time
DENSE = 512  # members beyond which a region is cut into tiles of about as many, whose pairs are dealt over tasks
BELOW = 0.15  # share of equal signature values below the similarity asked for, beyond which a pair is not tested
LEAST = 256  # least shingle names that a region's members bring along: of a set with no more of them, all
BELOW_BOTH = 0.1  # the same share of values and names together, where a set has more names than that
PAIRS = 2_048  # pairs whose names are compared at a time
MERGES = 2  # rounds of merging by best pairs before all pairs between groups are compared
FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U)) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWERED = bytes(LOWER)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of each text's distinct shingles, sorted, one text after the other, and their numbers.

    A text of fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    high, _, counts = word_names([x.translate(LOWERED) for x in texts])
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(texts)), counts)
    room = np.repeat(ends, counts) - np.arange(len(high))
    whole = np.minimum(size, counts)[of]
    names = high.copy()
    for k in range(1, size):
        more = np.r_[high[k:], np.zeros(min(k, len(high)), U)]
        names = np.where(whole > k, name(names, more), names)
    names = mix(names + whole.astype(U))
    keep = room >= whole
    names, of = names[keep], of[keep]
    order = np.lexsort((names, of))
    names, of = names[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (names[1:] != names[:-1])
    return names[new], np.bincount(of[new], minlength=len(texts))


def signatures(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free names of each set and its least values under TREES * DEPTH orders (16 bits of each)."""
    n = len(counts)
    values, sums = np.zeros((n, len(FACTORS)), np.uint16), [np.zeros(n, np.int64) for _ in range(2)]
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.r_[0, np.cumsum(counts)][:-1][full]
        for s, seed in zip(sums, (0x51ED, 0xA3C5), strict=True):
            s[full] = np.add.reduceat(mix(names ^ U(seed)), starts).view(np.int64)
        for j, f in enumerate(FACTORS):
            values[full, j] = (mix(np.minimum.reduceat(names * f, starts)) & U(0xFFFF)).astype(np.uint16)
    return *sums, values


def sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(counts, *signatures(names, counts)) for names, counts in (shingles(t, size) for t in portions(texts_of(batch.column("text"))))]
            if not made:
                continue
            counts, a, b, values = map(np.concatenate, zip(*made, strict=True))
            sig = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(a), pa.array(b), sig], ["id", "n", "key_a", "key_b", "sig"])

    return run


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and tree: the tree, and names of the prefixes of 6, 8 and 12 values of its label there."""
    for batch in batches:
        n = batch.num_rows
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, -1).astype(U)
        at = np.arange(TREES)[:, None] * DEPTH
        wide = values[:, (at + np.arange(12)) % values.shape[1]]
        packed = lambda a, b: reduce(lambda x, y: mix(x * U(0x10001) + y), [wide[:, :, k] for k in range(a, b)])
        p6 = mix(packed(0, 6) + np.arange(TREES, dtype=U))
        p8 = mix(p6 ^ packed(6, 8))
        p12 = mix(p8 ^ packed(8, 12))
        per = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), TREES), pa.int64())
        columns = [pa.array(p.ravel().view(np.int64)) for p in (p6, p8, p12)]
        tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), n))
        yield pa.RecordBatch.from_arrays([tree, *columns, per("id"), per("n")], ["tree", "p6", "p8", "p12", "id", "n"])


LABELS = "tree int, p6 long, p8 long, p12 long, id long, n long"
NEXT = "edge boolean, part int, p6 long, a long, na long, b long, nb long, group long"


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in label order: those of two groups next to each other with a common prefix; and the partition's ends."""
    part, before, first = TaskContext.get().partitionId(), None, None

    def rows(edge: bool, *columns) -> pa.RecordBatch:
        k = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([edge] * k, pa.bool_()), pa.array([part] * k, pa.int32()), *(pa.array(x, pa.int64()) for x in columns)], ["edge", "part", "p6", "a", "na", "b", "nb", "group"])

    for batch in batches:
        if not batch.num_rows:
            continue
        p, i, n, g = (batch.column(c).to_numpy() for c in ("p6", "id", "n", "comp"))
        first = first or tuple(int(x[0]) for x in (p, i, n, g))
        if before:
            p, i, n, g = (np.r_[np.int64(x), y] for x, y in zip(before, (p, i, n, g), strict=True))
        before = tuple(int(x[-1]) for x in (p, i, n, g))
        hit = np.flatnonzero((p[1:] == p[:-1]) & (g[1:] != g[:-1]))
        yield rows(False, p[1:][hit], i[:-1][hit], n[:-1][hit], i[1:][hit], n[1:][hit], g[1:][hit])
    if first:
        # two rows for the ends: prefix, id, size and group of the first (b = 0) and of the last row (b = 1)
        yield rows(True, *([x, y] for x, y in zip(first[:3], before[:3], strict=True)), [0, 1], [0, 0], [first[3], before[3]])


def adjacent(scratch: Scratch, labels: DataFrame, name: str) -> DataFrame:
    """(a, na, b, nb) of rows of two groups that are next to each other in the order of labels and share a prefix."""
    ordered = labels.repartitionByRange(partitions(labels.sparkSession), "p6", "p8", "p12", "id").sortWithinPartitions("p6", "p8", "p12", "id")
    near = scratch.freeze(ordered.select("p6", "id", "n", "comp").mapInArrow(neighbours, NEXT), name)
    line = Window.orderBy("part", "b")  # two rows a partition
    last = lambda c: F.lag(c).over(line)
    seam = near.where("edge").select("p6", "a", "na", "group", "b", last("p6").alias("q6"), last("a").alias("z"), last("na").alias("nz"), last("group").alias("h"))
    seam = seam.where("b = 0 AND p6 = q6 AND group <> h").select("a", "na", F.col("z").alias("b"), F.col("nz").alias("nb"))
    return near.where("NOT edge").select("a", "na", "b", "nb").union(seam)


def tiled(rows: DataFrame) -> DataFrame:
    """rows (p6, id, comp and others) of regions with more than one component, once for each pair of tiles to compare.

    A region of DENSE rows at most is one tile, compared with itself. In larger ones the largest component has tiles of
    its own, which meet those of the rest only; tiles of the rest meet each other and themselves. x and y are the tiles
    that meet (equal: one with itself), tile is the row's own.
    """
    per = rows.groupBy("p6", "comp").agg(F.count("*").alias("m"))
    size = per.groupBy("p6").agg(F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    size = size.select("p6", F.expr(f"size <= {DENSE}").alias("whole"), F.col("top.comp").alias("main"), F.expr(f"CAST(ceil(top.m / {DENSE}) AS INT)").alias("own"), F.expr(f"CAST(ceil((size - top.m) / {DENSE}) AS INT)").alias("rest"))
    placed = rows.join(size, "p6").withColumn("tile", F.expr("CASE WHEN whole THEN 0 WHEN comp = main THEN rest + pmod(xxhash64(id), own) ELSE pmod(xxhash64(id), rest) END").cast("int"))
    met = F.explode(F.expr("CASE WHEN whole THEN array(0) WHEN comp = main THEN sequence(0, rest - 1) ELSE sequence(0, rest + own - 1) END"))
    placed = placed.withColumn("met", met).withColumns({"x": F.least("tile", "met"), "y": F.greatest("tile", "met")})
    return placed.drop("whole", "main", "own", "rest", "met")


def least_names(size: int):
    """(id, low) of texts: the LEAST least names of the shingle set, 32 bits of each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low: list[bytes] = []
            for texts in portions(texts_of(batch.column("text"))):
                names, counts = shingles(texts, size)
                short, cut = (mix(names) >> U(32)).astype(np.uint32), np.r_[0, np.cumsum(counts)]
                low += [np.sort(short[x:y])[:LEAST].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(low, pa.binary())], ["id", "low"])

    return run


def likely(percent: int, low: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, equal: np.ndarray, values: int) -> np.ndarray:
    """Which pairs (x, y) of sets can be similar by their least names.

    Where both sets have LEAST shingles at most, their names are the sets: the answer is that of the full sets, but for
    one name, since two of a set may agree in 32 bits. Of larger ones the names up to the last that both bring are a sample of the
    union, which counts together with the signatures (equal of so many values).
    """
    ok, pad = np.empty(len(x), bool), np.uint32(0xFFFFFFFF)
    padded = lambda part: np.stack([np.r_[low[i], np.full(LEAST - len(low[i]), pad)] for i in part])
    last = np.array([v[-1] if len(v) == LEAST and m > LEAST else pad - 1 for v, m in zip(low, n, strict=True)], np.uint32)
    for p in range(0, len(x), PAIRS):
        a, b = x[p : p + PAIRS], y[p : p + PAIRS]
        (some, i), (more, j) = (np.unique(c, return_inverse=True) for c in (a, b))
        both = np.sort(np.hstack([padded(some)[i], padded(more)[j]]), axis=1)
        inside = both <= np.minimum(last[a], last[b])[:, None]
        met = ((both[:, 1:] == both[:, :-1]) & inside[:, 1:]).sum(1)
        union = inside.sum(1) - met
        whole = (n[a] <= LEAST) & (n[b] <= LEAST)
        exact = 100 * (met + 1) >= percent * (n[a] + n[b] - met - 1)
        sampled = met + equal[p : p + PAIRS] >= (percent / 100 - BELOW_BOTH) * (union + values)
        ok[p : p + PAIRS] = np.where(whole, exact, sampled)
    return ok


def promising(percent: int):
    """Of two tiles of a region, the pairs of two groups that can be similar by their signatures and least names.

    At a similarity of 0.8 the share of equal signature values is below 0.65 twice in 100,000,000 times, and that of
    values and names together below 0.7 as seldom. A pair that shares prefixes in several trees comes from the first of
    them only.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, n, comp, tile = (t[c].to_numpy() for c in ("id", "n", "comp", "tile"))
        tree, alone = t["tree"][0].as_py(), key[1].as_py() == key[2].as_py()
        values = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(ids), -1)
        low = [np.frombuffer(v, np.uint32) for v in t["low"].to_pylist()]
        least = (percent / 100 - BELOW) * values.shape[1]
        one = np.flatnonzero(tile == key[1].as_py())
        two = one if alone else np.flatnonzero(tile == key[2].as_py())
        found: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], ids[:0])]
        for i in range(0, len(one), TILE):
            for j in range(i if alone else 0, len(two), TILE):
                x, y = one[i : i + TILE], two[j : j + TILE]
                ok = (comp[x, None] != comp[None, y]) & (ids[x, None] != ids[None, y])
                ok &= 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
                if alone and i == j:
                    ok = np.triu(ok, 1)
                if 8 * np.count_nonzero(ok) > ok.size:  # most of them at once, a value at a time
                    same = np.zeros(ok.shape, np.uint8)
                    for p, q in zip(np.ascontiguousarray(values[x].T), np.ascontiguousarray(values[y].T), strict=True):
                        same += p[:, None] == q
                    ok &= same >= least
                u, v = np.nonzero(ok)
                u, v = x[u], y[v]
                equal = values[u] == values[v]
                share = equal.sum(1)
                like = (share >= least) & (equal.reshape(-1, TREES, DEPTH).all(2).argmax(1) == tree)
                u, v = u[like], v[like]
                like = likely(percent, low, n, u, v, share[like], values.shape[1])
                found.append((ids[u[like]], ids[v[like]]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def similar(percent: int, size: int):
    """Of pairs with both texts, those whose full shingle sets have an intersection of percent of their union at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [texts_of(batch.column(c)) for c in ("text_a", "text_b")]
            place: dict[bytes, int] = {}
            at = [[place.setdefault(x, len(place)) for x in t] for t in texts]
            names, counts = shingles(list(place), size)
            cut = np.r_[0, np.cumsum(counts)]
            ok = np.zeros(batch.num_rows, bool)
            for k, (i, j) in enumerate(zip(*at, strict=True)):
                x, y = names[cut[i] : cut[i + 1]], names[cut[j] : cut[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both) > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def components(scratch: Scratch, links: DataFrame, tag: str, known: DataFrame | None = None) -> DataFrame:
    """(id, comp) for every linked id: the least id that links lead to. known: what earlier links gave, which these add to.

    Rounds of hooking each to its least neighbour and following hooks to their end, each round a written table; nothing
    is collected. As many partitions are used as the number of links asks for.
    """
    links = scratch.freeze(links.select("a", "b"), f"{tag}_links")
    rows = 2 * links.count() + (known.count() if known is not None else 0)
    few = lambda df: gathered(df, rows)
    edges, root, k = few(links), known, 0

    def renamed(pairs: DataFrame, step: DataFrame) -> DataFrame:
        """Pairs of the groups that pairs of ids are in now."""
        a, b = (few(step).select(F.col("id").alias(c), F.col("comp").alias(f"{c}_to")) for c in "ab")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        return pairs.where("a <> b").distinct()

    def jumped(hook: DataFrame) -> DataFrame:
        end = hook.select(F.col("id").alias("to"), F.col("to").alias("end"))
        return hook.join(end, "to", "left").select("id", F.coalesce("end", "to").alias("to"))

    if known is not None:
        edges = few(scratch.freeze(renamed(edges, known), f"{tag}_start", rows))
    while True:
        both = few(edges.union(edges.select("b", "a")).where("a <> b"))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        hook = few(scratch.freeze(hook, f"{tag}_hook{k}", rows))
        if hook.isEmpty():
            return root if root is not None else links.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0)
        j = 0
        while True:  # hooks lead to smaller ids, so following them eight times as far each time ends
            further = jumped(jumped(jumped(hook)))
            old = hook.select("id", F.col("to").alias("old"))
            hook = few(scratch.freeze(further.join(old, "id"), f"{tag}_hook{k}_{j}", rows))
            moved, hook, j = hook.where("to <> old"), hook.select("id", "to"), j + 1
            if moved.isEmpty():
                break
        step = hook.select("id", F.col("to").alias("comp"))
        if root is None:
            root = step
        else:
            # groups that have moved, and ids that were in none before
            moved = few(root).join(step.select(F.col("id").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("id", F.coalesce("now", "comp").alias("comp"))
            root = few(scratch.freeze(moved.union(step.join(few(root).select("id"), "id", "left_anti")), f"{tag}_root{k}", rows))
        edges = few(scratch.freeze(renamed(edges, step), f"{tag}_edges{k}", rows))
        k += 1


def grouped(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def near_classes(docs: DataFrame, percent: int = 80, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs with an id; see minhash_dedup."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    sets = scratch.freeze(source.mapInArrow(sketched(shingle_words), "id long, n long, key_a long, key_b long, sig binary"), "sets")
    # equal sets are one class; from here on only its least id takes part
    classes = scratch.freeze(sets.where("n > 0").groupBy("key_a", "key_b").agg(F.min("id").alias("rep")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("id"), "key_a", "key_b"), ["id", "key_a", "key_b"], "left_semi").dropDuplicates(["id", "key_a", "key_b"])
    labels = reps.select("id", "n", "sig").mapInArrow(labelled, LABELS)
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    beside = adjacent(scratch, labels.withColumn("comp", F.col("id")), "beside").where(fits)
    involved = scratch.freeze(beside.select(F.col("a").alias("id")).union(beside.select("b")).distinct(), "involved")
    rows = scratch.freeze(reps.join(involved, "id", "left_semi").select("id", "n", "sig").mapInArrow(labelled, LABELS), "labels")
    # the texts of those that share a prefix with any other
    texts = scratch.bucketed(source.join(reps.select("id"), "id", "left_semi").join(involved, "id", "left_semi").dropDuplicates(), "id", parts)

    def confirmed(cands: DataFrame, tag: str) -> DataFrame:
        x = cands.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        x = x.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return scratch.freeze(x.mapInArrow(similar(percent, shingle_words), "a long, b long"), tag)

    def across(cands: DataFrame, comps: DataFrame) -> DataFrame:
        a, b = (comps.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
        cands = cands.join(a, "a", "left").join(b, "b", "left").withColumns({f"comp_{c}": F.coalesce(f"comp_{c}", c) for c in "ab"})
        return cands.where("comp_a <> comp_b")

    # the hub of a region shares the most prefixes with others: what near copies were made from, or close to it
    shared = rows.join(rows.groupBy("p6").agg(F.count("*").alias("size")).where("size > 1"), "p6")
    score = shared.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = rows.join(score, "id").groupBy("p6").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("hub"))
    to_hub = rows.join(hubs, "p6").select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hub.id").alias("b"), F.col("hub.n").alias("nb")).where("a <> b").where(fits)
    best = to_hub.groupBy("a", "b").agg(F.count("*").alias("trees")).groupBy("a").agg(F.max_by("b", F.struct("trees", -F.col("b"))).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = scratch.freeze(best, "to_hubs")
    links = confirmed(tested, "links_hubs")
    comps = components(scratch, links, "hubs")

    # neighbours of different groups are compared best first: a pair for each group, at last all that are still apart
    apart = adjacent(scratch, grouped(rows, comps), "neighbours").where(fits).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("trees"))
    apart = scratch.freeze(apart.join(tested, ["a", "b"], "left_anti"), "apart")
    for k in range(MERGES + 1):
        most = apart.count()
        if not most:
            break
        picked = apart = scratch.freeze(across(apart.select("a", "b", "trees"), comps), f"apart{k}", most)
        if k < MERGES:
            sides = apart.select(F.col("comp_a").alias("comp"), "a", "b", "trees").union(apart.select("comp_b", "a", "b", "trees"))
            picked = gathered(sides, 2 * most).groupBy("comp").agg(F.max_by(F.struct("a", "b"), F.struct("trees", -F.col("a"), -F.col("b"))).alias("pair")).select("pair.*").distinct()
        picked = scratch.freeze(picked.select("a", "b"), f"picked{k}", most)
        tested = tested.union(picked)
        comps = components(scratch, confirmed(picked, f"links{k}"), f"merge{k}", comps)
        apart = apart.join(picked, ["a", "b"], "left_anti")

    # last, regions that still hold more than one component: all pairs across components, whatever their size
    rows = scratch.freeze(grouped(rows, comps), "grouped")
    here = scratch.freeze(tiled(rows.select("p6", "tree", "id", "n", "comp")), "tiles")
    low = texts.join(here.select("id").distinct(), "id", "left_semi").mapInArrow(least_names(shingle_words), "id long, low binary")
    here = here.join(reps.select("id", "sig"), "id").join(low, "id")
    cands = here.groupBy("p6", "x", "y").applyInArrow(promising(percent), "a long, b long")
    rest = cands.distinct().join(tested, ["a", "b"], "left_anti")
    comps = components(scratch, confirmed(rest, "links_rest"), "rest", comps)

    named = sets.select("id", "n", "key_a", "key_b").join(classes, ["key_a", "key_b"], "left")
    named = named.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "id").alias("component_id"))


def minhash_dedup(docs: DataFrame, percent: int = 80, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept: of each group of near duplicates the one with the smallest id, with all its columns.

    A document's set holds the distinct shingles of its words, A-Z lowered (fewer words than a shingle: the whole
    sequence); documents are linked when the intersection is percent of the union at least, and groups are what links
    connect. An LSH forest finds the pairs: each of TREES sorted orders ranks documents by a label of min-hash values,
    and those next to each other with a common prefix are compared, and each with the hub of its region (equal prefix);
    then all pairs across groups inside a region of any size, in tiles. Every link is confirmed on the full sets. Equal
    sets are one class from the start, so copies are never paired.

    Null or wordless texts are linked with nothing and kept. Rows without an id are kept and linked with nothing.
    Repeated rows stay or go together, and so do rows of one id with different texts: they go if any of them does. An
    empty table gives an empty result. Other columns pass through, as long as they do not start with two underscores.
    """
    found = near_classes(docs, percent, shingle_words, id_col, text_col)
    gone = found.where("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_classes(docs, 80, shingle_words=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
