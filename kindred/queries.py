"""Registered queries over the test tables, and DuckDB SQL for those that SQL can express.

Values are rounded to six places where they come from divisions or roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import sql_text as T
from kindred.functions import codes, english, french, hashes, keyers, metrics, phonetics, segmenters, sequences, stemmers, text, tokens, vectors
from kindred.functions.double_metaphone import double_metaphone_column
from kindred.functions.sonnex import sonnex_column
from kindred.operators import frequencies, linkage, punkt, rake, word_pairs
from kindred.plans.scratch import Scratch
from kindred.sources import parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) of all pairs of distinct part names, of which there are few at any size."""
    n = names(spark, sf_dir)
    return n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), F.expr("a < b"))


PAIRS = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), pairs AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name)"
CHARS = "list_distinct(string_split({0}, ''))"
SETS = f"{PAIRS}, sets AS (SELECT a, b, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM pairs), sizes AS (SELECT a, b, len(list_intersect(x, y)) AS i, len(x) AS nx, len(y) AS ny FROM sets)"
GRAMS = f"{PAIRS}, sets AS (SELECT a, b, list_distinct(list_transform(range(1, len(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: substr(b, i, 2))) AS y FROM pairs), sizes AS (SELECT a, b, len(list_intersect(x, y)) AS i, len(x) AS nx, len(y) AS ny FROM sets)"


def lowered(c: str) -> Column:
    """Lower case as DuckDB has it, each character by itself: no combining dot, no final sigma."""
    return F.lower(F.replace(F.replace(F.col(c), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# --- keys and tokens -----------------------------------------------------------------------------------------------


@query("SELECT key, len(members) AS size, array_to_string(list_sort(members), '|') AS members FROM (SELECT array_to_string(list_sort(list_distinct(string_split_regex(trim(regexp_replace(lower(p_name), '[[:punct:]]', '', 'g')), '\\s+'))), ' ') AS key, list(DISTINCT p_name) AS members FROM part GROUP BY 1) WHERE len(members) >= 1")
def key_collision_fingerprint(spark, sf_dir):
    """Part names that share a fingerprint."""
    found = linkage.key_collision(table(spark, sf_dir, "part"), F.array(keyers.fingerprint("p_name")), "p_name", min_size=1)
    return found.select("key", F.size("members").cast("long").alias("size"), F.array_join("members", "|").alias("members"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, len(s)), lambda i: substr(s, i, 2)))), '') AS key FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[[:punct:]]', '', 'g'), '\\s+', '', 'g') AS s FROM part)")
def ngrams_fingerprint_key(spark, sf_dir):
    """K4: bigram fingerprints of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", keyers.ngrams_fingerprint("p_name", 2).alias("key"))


@query(T.keyers_all())
def keyers_all(spark, sf_dir):
    """The other keys of part names."""
    n = names(spark, sf_dir)
    sets = F.size(keyers.name_power_set("name")).cast("long")
    return n.select("name", keyers.name_fingerprint("name").alias("fingerprint"), keyers.name_signature("name").alias("signature"), keyers.omission("name").alias("omission"), keyers.skeleton("name").alias("skeleton"), sets.alias("sets"))


@query("SELECT doc_id, len(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, strip_accents(replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'ß', 'ss')) AS n FROM documents)")
def normalize_text(spark, sf_dir):
    """K2, K8: normalised texts."""
    n = F.col("n")
    return table(spark, sf_dir, "documents").select("doc_id", keyers.normalize("text").alias("n")).select("doc_id", F.char_length(n).cast("long").alias("n_chars"), F.md5(F.encode(n, "UTF-8")).alias("digest"))


@query("SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(text) + 1), lambda i: i = 1 OR substr(text, i, 1) <> substr(text, i - 1, 1)), lambda i: substr(text, i, 1)), '') AS squeezed FROM benchmark")
def squeeze_text(spark, sf_dir):
    """Runs of a character once."""
    return table(spark, sf_dir, "benchmark").select("item_id", text.squeeze("text").alias("squeezed"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(name)), lambda i: substr(name, i, 2))) AS gram FROM (SELECT DISTINCT p_name AS name FROM part)) GROUP BY gram")
def bigram_frequencies(spark, sf_dir):
    """Bigrams of part names, counted."""
    return frequencies.frequencies(names(spark, sf_dir).select(tokens.bigrams("name").alias("g")), "g").select(F.col("value").alias("gram"), F.col("count").alias("n"))


@query("WITH f AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1) SELECT value, round(n / sum(n) OVER (), 6) AS share FROM f")
def relative_frequencies(spark, sf_dir):
    """A2: shares of market segments."""
    f = frequencies.relative(frequencies.frequencies(table(spark, sf_dir, "customer"), "c_mktsegment"))
    return f.select("value", F.round("share", 6).alias("share"))


@query("SELECT value, count(*) AS count FROM (SELECT lang AS value FROM documents UNION ALL SELECT role FROM conversations) GROUP BY value")
def updated_frequencies(spark, sf_dir):
    """A3: two frequency tables as one."""
    f = frequencies.frequencies
    return frequencies.updated(f(table(spark, sf_dir, "documents"), "lang"), f(table(spark, sf_dir, "conversations"), "role"))


def digest(c: Column) -> Column:
    """What tells one array of strings from another."""
    return F.md5(F.encode(F.array_join(c, "|"), "UTF-8"))


@query("SELECT doc_id, len(l) AS lines, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n\\r|\\n|\\r') AS l FROM documents)")
def line_tokens(spark, sf_dir):
    """T5."""
    t = table(spark, sf_dir, "documents").select("doc_id", tokens.lines("text").alias("l"))
    return t.select("doc_id", F.size("l").cast("long").alias("lines"), digest("l").alias("digest"))


@query("SELECT conv_id, turn, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM (SELECT conv_id, turn, string_split_regex(text, '(\\r\\n|\\n\\r|\\n|\\r)\\s*(\\r\\n|\\n\\r|\\n|\\r)') AS p FROM conversations)")
def paragraph_tokens(spark, sf_dir):
    """T6."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.paragraphs("text").alias("p"))
    return t.select("conv_id", "turn", F.size("p").cast("long").alias("paragraphs"), digest("p").alias("digest"))


@query()
def naive_words(spark, sf_dir):
    """Words of conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.words_naive("text").alias("words"))


@query(f"SELECT conv_id, turn, len(w) AS words, md5(array_to_string(w, '|')) AS digest FROM (SELECT conv_id, turn, {T.treebank('text')} AS w FROM conversations)")
def treebank_words(spark, sf_dir):
    """Words of conversations."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.words_treebank("text").alias("w"))
    return t.select("conv_id", "turn", F.size("w").cast("long").alias("words"), digest("w").alias("digest"))


@query("SELECT doc_id, len(f) AS numbers, md5(array_to_string(f, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS f FROM documents)")
def found_numbers(spark, sf_dir):
    """All matches of a pattern."""
    t = table(spark, sf_dir, "documents").select("doc_id", text.findall("text", "[0-9]+").alias("f"))
    return t.select("doc_id", F.size("f").cast("long").alias("numbers"), digest("f").alias("digest"))


@query("SELECT item_id, len(text) AS size, md5(array_to_string(list_filter(string_split(text, ''), lambda c: c <> ''), '|')) AS digest FROM benchmark")
def character_sequences(spark, sf_dir):
    """Texts as arrays of characters."""
    t = table(spark, sf_dir, "benchmark").select("item_id", text.chars("text").alias("c"))
    return t.select("item_id", F.size("c").cast("long").alias("size"), digest("c").alias("digest"))


@query("SELECT doc_id, md5(translate(text, 'aeiouéèü', '123456#+')) AS digest FROM documents")
def translated_texts(spark, sf_dir):
    """Characters that become those in the same place of another alphabet."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(text.translation("text", "aeiouéèü", "123456#+"), "UTF-8")).alias("digest"))


CLASSES = {"single_quotes": text.SINGLE_QUOTES, "double_quotes": text.DOUBLE_QUOTES, "hyphens": text.HYPHENS, "commas": text.COMMAS}


@query("SELECT doc_id, " + ", ".join(f"CAST({' + '.join('len(text) - len(replace(text, chr(%d), chr(0)[1:0]))' % ord(c) for c in dict.fromkeys(v))} AS BIGINT) AS {k}" for k, v in CLASSES.items()).replace("chr(0)[1:0]", "''") + " FROM documents")
def character_classes(spark, sf_dir):
    """How many characters of each class a text has."""
    held = lambda v: (F.char_length("text") - F.char_length(F.translate("text", v, ""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", *(held(v).alias(k) for k, v in CLASSES.items()))


@query("SELECT item_id, s AS sentence, CAST(p AS INTEGER) AS pos, w AS word, 'T' || len(w) AS tag, CASE WHEN p = 0 THEN 'B' ELSE 'I' END AS chunk FROM (SELECT item_id, CAST(s - 1 AS INTEGER) AS s, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT item_id, s, string_split(l[s], ' ') AS ws FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS s FROM (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM benchmark))))")
def chunked_words(spark, sf_dir):
    """Sentences of the benchmark written as lines of word, tag and chunk, and parsed again."""
    sentences = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    line = lambda w, i: F.concat_ws(" ", w, F.concat(F.lit("T"), F.char_length(w)), F.when(i == 0, "B").otherwise("I"))
    written = F.array_join(F.transform(sentences, lambda x: F.array_join(F.transform(F.split(x, " "), line), "\n")), "\n\n")
    t = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parsers.conll(written)).alias("sentence", "tokens"))
    return t.select("item_id", "sentence", F.posexplode("tokens").alias("pos", "t")).select("item_id", "sentence", "pos", "t.word", F.col("t.pos").alias("tag"), "t.chunk")


@query("SELECT n_name, array_to_string(list_transform(range(1, len(n_name)), lambda i: substr(n_name, i, 1) || substr(n_name, i + 1, 1) || CASE WHEN i + 2 <= len(n_name) THEN '|' || substr(n_name, i, 1) || substr(n_name, i + 2, 1) ELSE '' END), '|') AS grams FROM nation")
def skip_bigrams(spark, sf_dir):
    """T4: bigrams of nation names that may skip one letter."""
    g = F.transform(tokens.skipgrams(text.chars("n_name"), 1, 2), lambda x: F.array_join(x, ""))
    return table(spark, sf_dir, "nation").select("n_name", F.array_join(g, "|").alias("grams"))


@query("SELECT p_partkey, regexp_replace(p_name, '([|\\\\{}()\\[\\]^$+*?.\\-])', '\\\\\\1', 'g') AS escaped FROM part")
def escaped_patterns(spark, sf_dir):
    """R1."""
    return table(spark, sf_dir, "part").select("p_partkey", text.escape_regexp("p_name").alias("escaped"))


@query("SELECT n_name, array_to_string(list_transform(string_split(n_name, ''), lambda c: '(' || c || ')'), '.*?') AS pattern FROM nation WHERE regexp_matches(n_name, '^[A-Z_0-9a-z ]*$')")
def fuzzy_patterns(spark, sf_dir):
    """R2."""
    return table(spark, sf_dir, "nation").where(F.col("n_name").rlike("^[A-Z_0-9a-z ]*$")).select("n_name", text.fuzzy_pattern("n_name").alias("pattern"))


# --- metrics on strings ----------------------------------------------------------------------------------------------


@query(f"{PAIRS} SELECT a, b, levenshtein(a, b) AS distance, CASE WHEN levenshtein(a, b) > 4 THEN -1 ELSE levenshtein(a, b) END AS limited FROM pairs")
def levenshtein_pairs(spark, sf_dir):
    """M3, M3b; -1 stands for infinity."""
    lim = metrics.levenshtein_limited(4, "a", "b")
    return name_pairs(spark, sf_dir).select("a", "b", metrics.levenshtein("a", "b").cast("long").alias("distance"), F.when(lim == float("inf"), -1).otherwise(lim.cast("long")).cast("long").alias("limited"))


@query(f"{SETS} SELECT a, b, round(i / (nx + ny - i), 6) AS jaccard, round(i / least(nx, ny), 6) AS overlap, round(i / (i + 0.3 * (nx - i) + 0.7 * (ny - i)), 6) AS tversky FROM sizes")
def set_similarities(spark, sf_dir):
    """M6-M8."""
    return name_pairs(spark, sf_dir).select("a", "b", rounded(metrics.jaccard("a", "b")).alias("jaccard"), rounded(metrics.overlap("a", "b")).alias("overlap"), rounded(metrics.tversky("a", "b", 0.3, 0.7)).alias("tversky"))


@query(f"{GRAMS} SELECT a, b, round(2 * i / (nx + ny), 6) AS dice FROM sizes")
def dice_similarity(spark, sf_dir):
    """M4, M5."""
    return name_pairs(spark, sf_dir).select("a", "b", rounded(metrics.dice("a", "b")).alias("dice"))


@query(f"{PAIRS} SELECT a, b, round(least(len(a), len(b)) / greatest(len(a), len(b)), 6) AS length, round((greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)), 6) AS lig2, round(2 * (greatest(len(a), len(b)) - levenshtein(a, b)) / (2 * greatest(len(a), len(b)) - levenshtein(a, b)), 6) AS lig3, CAST(a = b AS DOUBLE) AS identity FROM pairs")
def length_similarities(spark, sf_dir):
    """M14, M16, M17."""
    return name_pairs(spark, sf_dir).select("a", "b", rounded(metrics.length_similarity("a", "b")).alias("length"), rounded(metrics.lig2("a", "b")).alias("lig2"), rounded(metrics.lig3("a", "b")).alias("lig3"), metrics.identity_similarity("a", "b").alias("identity"))


@query(f"{PAIRS}, c AS (SELECT a, b, list_filter(range(0, least(len(a), len(b)) + 1), lambda k: left(a, k) = left(b, k)) AS p, list_filter(range(0, least(len(a), len(b)) + 1), lambda k: right(a, k) = right(b, k) OR k = 0) AS s FROM pairs) SELECT a, b, round(list_max(p) / least(len(a), len(b)), 6) AS prefix, round(list_max(s) / least(len(a), len(b)), 6) AS suffix FROM c")
def prefix_suffix(spark, sf_dir):
    """M28, M29."""
    return name_pairs(spark, sf_dir).select("a", "b", rounded(metrics.prefix("a", "b")).alias("prefix"), rounded(metrics.suffix("a", "b")).alias("suffix"))


@query("WITH n AS (SELECT DISTINCT p_brand AS name FROM part), pairs AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND len(x.name) = len(y.name)) SELECT a, b, hamming(a, b) AS distance, round(hamming(a, b) / len(a), 6) AS normalized FROM pairs")
def hamming_brands(spark, sf_dir):
    """M11, M11b."""
    n = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), F.expr("a < b AND length(a) = length(b)"))
    return pairs.select("a", "b", metrics.hamming("a", "b").cast("long").alias("distance"), rounded(metrics.hamming_normalized("a", "b")).alias("normalized"))


@query("SELECT o_orderkey, CAST(bit_count(xor(o_orderkey, o_custkey)) AS BIGINT) AS bits FROM orders")
def hamming_bits(spark, sf_dir):
    """M11c."""
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.hamming_bitwise("o_orderkey", "o_custkey").cast("long").alias("bits"))


@query(f"{PAIRS} SELECT a, b, CAST(greatest(len(a), len(b)) - list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(len(list_filter(string_split(a, ''), lambda v: v = c)), len(list_filter(string_split(b, ''), lambda v: v = c))))) AS BIGINT) AS bag FROM pairs")
def bag_distance(spark, sf_dir):
    """M1."""
    return name_pairs(spark, sf_dir).select("a", "b", metrics.bag("a", "b").cast("long").alias("bag"))


@query(f"{PAIRS} SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM pairs")
def jaro_pairs(spark, sf_dir):
    """M9, M10."""
    return name_pairs(spark, sf_dir).select("a", "b", rounded(sequences.jaro_column("a", "b")).alias("jaro"), rounded(sequences.jaro_winkler_column("a", "b")).alias("jaro_winkler"))


@query(T.guth(PAIRS))
def guth_pairs(spark, sf_dir):
    """M13."""
    return name_pairs(spark, sf_dir).select("a", "b", sequences.guth_column("a", "b").alias("guth"))


@query(T.mra(PAIRS))
def mra_pairs(spark, sf_dir):
    """M26."""
    p = name_pairs(spark, sf_dir).select("a", "b", sequences.mra_column("a", "b").alias("m")).where("m IS NOT NULL")
    return p.select("a", "b", F.col("m.codex")[0].alias("codex_a"), F.col("m.codex")[1].alias("codex_b"), "m.minimum", "m.similarity", "m.matching")


@query(f"{PAIRS} SELECT a, b, {T.SMITH_WATERMAN} AS smith_waterman FROM pairs")
def smith_waterman_pairs(spark, sf_dir):
    """M32."""
    return name_pairs(spark, sf_dir).select("a", "b", sequences.smith_waterman_column("a", "b").alias("smith_waterman"))


@query()
def sequence_kernels(spark, sf_dir):
    """M30, M31."""
    one = {k: getattr(sequences, f"{k}_column")("a", "b").alias(k) for k in ("ratcliff_obershelp", "sift4")}
    return name_pairs(spark, sf_dir).select("a", "b", *one.values())


def words(spark, sf_dir) -> DataFrame:
    """Distinct words of all documents, in four languages with marks, with their first and last three characters."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(lowered("text"), r"[\x00-\x60{-~\s]+")).alias("w")).where("w <> '' AND length(w) > 4").distinct()
    return w.select("w", F.substring("w", 1, 3).alias("head"), F.right("w", F.lit(3)).alias("tail"))


WORD_PAIRS = "WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[\\x00-\\x60{-~\\s]+')) AS w FROM documents) WHERE len(w) > 4), pairs AS (SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON left(x.w, 3) = left(y.w, 3) AND right(x.w, 3) = right(y.w, 3) AND x.w < y.w UNION ALL SELECT '', w FROM w)"
RUNS = "coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: coalesce(list_max(list_filter(range(1, len(a) - i + 2), lambda k: contains(b, substr(a, i, k)))), 0))), 0)"
APART = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) + abs(len(a) - len(b))"


@query(f"{WORD_PAIRS}, d AS (SELECT a, b, {APART} AS lipns, greatest(len(a), len(b)) AS n, {RUNS} AS run FROM pairs) SELECT a, b, CAST(lipns AS INTEGER) AS lipns, CAST(CASE WHEN a = '' THEN 0 WHEN n < 3 OR lipns / n <= 0.25 OR (lipns - 1) / (n - 1) <= 0.25 OR (lipns - 2) / (n - 2) <= 0.25 THEN 1 ELSE 0 END AS INTEGER) AS mlipns, round(run / n, 6) AS lcs FROM d")
def word_distances(spark, sf_dir):
    """M15, M25 on words with marks that share their first and last three characters, and on each with the empty word."""
    k, w = sequences, Scratch(spark).freeze(words(spark, sf_dir), "words")
    empty = w.select(F.lit("").alias("a"), F.col("w").alias("b"))
    empty = empty.select("a", "b", k.lipns_column("a", "b").alias("lipns"), k.mlipns_column("a", "b").alias("mlipns"), rounded(k.lcs_column("a", "b")).alias("lcs"))
    return word_pairs.block_distances(w, "w", ["head", "tail"]).union(empty)


@query(f"{PAIRS}, d AS (SELECT a, b, {T.ALIGNMENT} AS d FROM pairs) SELECT a, b, CAST(d AS INTEGER) AS distance, CAST(CASE WHEN d > 3 THEN -1 ELSE d END AS INTEGER) AS limited FROM d")
def damerau_levenshtein_pairs(spark, sf_dir):
    """M2, M2b; -1 stands for infinity."""
    lim = sequences.damerau_levenshtein_limited_column(3, "a", "b")
    p = name_pairs(spark, sf_dir).select("a", "b", sequences.damerau_levenshtein_column("a", "b").alias("distance"), lim.alias("l"))
    return p.select("a", "b", "distance", F.when(F.col("l") == float("inf"), -1).otherwise(F.col("l").cast("int")).cast("int").alias("limited"))


@query(f"{PAIRS}, t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pairs) SELECT a, b, round(list_avg(list_transform(x, lambda u: CASE WHEN list_contains(y, u) THEN 1.0 ELSE 0.0 END)), 6) AS monge_elkan FROM t")
def monge_elkan_names(spark, sf_dir):
    """M27 over words, with identity."""
    pairs = name_pairs(spark, sf_dir).select("a", "b", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))
    return pairs.select("a", "b", rounded(metrics.monge_elkan(metrics.identity_similarity, "x", "y")).alias("monge_elkan"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def vector_pairs(spark, sf_dir) -> DataFrame:
    """Each vector with the one whose id follows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


VECTORS = "WITH p AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
Z = "list_zip(a, b)"


@query(f"{VECTORS} SELECT vec_id, round(list_distance(a, b), 6) AS euclidean, round(list_sum(list_transform({Z}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS squared, round(list_sum(list_transform({Z}, lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(list_max(list_transform({Z}, lambda z: abs(z[1] - z[2]))), 6) AS chebyshev, round(list_cosine_similarity(a, b), 6) AS cosine, round(pow(list_sum(list_transform({Z}, lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3), 6) AS minkowski, round(list_sum(list_transform({Z}, lambda z: abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])))), 6) AS canberra, round(list_dot_product(a, b), 6) AS dot FROM p")
def vector_metrics(spark, sf_dir):
    """M18-M23, V5."""
    v = vectors
    cols = {"euclidean": v.euclidean("a", "b"), "squared": v.squared_euclidean("a", "b"), "manhattan": v.manhattan("a", "b"), "chebyshev": v.chebyshev("a", "b"), "cosine": v.cosine("a", "b"), "minkowski": v.minkowski(3, "a", "b"), "canberra": v.canberra("a", "b"), "dot": v.dot("a", "b")}
    return vector_pairs(spark, sf_dir).select("vec_id", *(rounded(c).alias(n) for n, c in cols.items()))


@query("SELECT label, CAST(i AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, i")
def mean_vectors(spark, sf_dir):
    """V4."""
    m = vectors.mean(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


@query(f"{VECTORS} SELECT vec_id, round(list_sum(list_transform({Z}, lambda z: 2 * (z[1] + z[2]) + 1)), 6) AS total FROM p")
def vector_arithmetic(spark, sf_dir):
    """V1-V3: twice the sum of two vectors and a vector of ones, added up."""
    s = vectors.add(vectors.scale(vectors.add("a", "b"), 2.0), vectors.vec(64, 1.0))
    return vector_pairs(spark, sf_dir).select("vec_id", rounded(F.aggregate(s, F.lit(0.0), lambda x, y: x + y)).alias("total"))


# --- hashes ----------------------------------------------------------------------------------------------------------


@query(T.CRC32)
def crc32_names(spark, sf_dir):
    """H1."""
    return names(spark, sf_dir).select("name", hashes.crc32("name").alias("crc32"))


def signed(spark, sf_dir) -> DataFrame:
    return names(spark, sf_dir).select("name", hashes.minhash("name", hashes.coefficients(16)).alias("signature"))


MINHASH = "list_transform([{0}], lambda p: list_min(list_transform(list_distinct(string_split(name, '')), lambda c: (p[1] * CAST(unicode(c) AS DOUBLE) + p[2]) % 4294967311.0::DOUBLE)))".format(", ".join(f"[{a:.1f}::DOUBLE, {b:.1f}::DOUBLE]" for a, b in hashes.coefficients(16)))


@query(f"SELECT name, CAST(i AS INTEGER) AS pos, s[i + 1] AS value FROM (SELECT name, {MINHASH} AS s, unnest(range(16)) AS i FROM (SELECT DISTINCT p_name AS name FROM part))")
def minhash_signatures(spark, sf_dir):
    """H2."""
    return signed(spark, sf_dir).select("name", F.posexplode("signature").alias("pos", "value"))


@query(f"WITH s AS (SELECT name, {MINHASH} AS s FROM (SELECT DISTINCT p_name AS name FROM part)) SELECT x.name AS a, y.name AS b, round(list_avg(list_transform(list_zip(x.s, y.s), lambda z: CASE WHEN z[1] = z[2] THEN 1.0 ELSE 0.0 END)), 6) AS similarity FROM s x JOIN s y ON x.name < y.name")
def minhash_similarities(spark, sf_dir):
    """M24."""
    s = signed(spark, sf_dir)
    pairs = s.select(F.col("name").alias("a"), F.col("signature").alias("x")).join(s.select(F.col("name").alias("b"), F.col("signature").alias("y")), F.expr("a < b"))
    return pairs.select("a", "b", rounded(metrics.minhash_similarity("x", "y")).alias("similarity"))


@query(f"WITH s AS (SELECT name, {MINHASH} AS s FROM (SELECT DISTINCT p_name AS name FROM part)), k AS (SELECT name, b, [s[b * 2 + 1], s[b * 2 + 2]] AS key FROM (SELECT name, s, unnest(range(8)) AS b FROM s)) SELECT x.name AS a, y.name AS b, count(*) AS bands FROM k x JOIN k y ON x.b = y.b AND x.key = y.key AND x.name < y.name GROUP BY 1, 2")
def lsh_pairs(spark, sf_dir):
    """H3: names that agree on bands of two values."""
    k = signed(spark, sf_dir).select("name", F.explode(hashes.bands("signature", 2, 16)).alias("k")).select("name", "k.band", "k.key")
    pairs = k.select(F.col("name").alias("a"), "band", "key").join(k.select(F.col("name").alias("b"), "band", "key"), ["band", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("bands"))


@query(f"WITH s AS (SELECT name, {MINHASH} AS s FROM (SELECT DISTINCT p_name AS name FROM part)), k AS (SELECT name, CAST(b AS INTEGER) AS band, array_to_string([s[b * 4 + 1], s[b * 4 + 2], s[b * 4 + 3], s[b * 4 + 4]], ',') AS key FROM (SELECT name, s, unnest(range(4)) AS b FROM s)) SELECT band, count(*) AS bins, CAST(sum(n) AS BIGINT) AS names FROM (SELECT band, key, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2) GROUP BY band")
def lsh_bins(spark, sf_dir):
    """H3: bins per band, and the names in them."""
    b = hashes.binning(signed(spark, sf_dir), "name", "signature", 4, 16)
    return b.groupBy("band").agg(F.countDistinct("bin").alias("bins"), F.count("*").alias("names"))


# --- phonetics and stems -------------------------------------------------------------------------------------------------


def english_words(spark, sf_dir) -> DataFrame:
    """The distinct words of part names, nations and English conversations, in lower case, dealt over all cores: few
    bytes, but much work each."""
    sources = [("part", "p_name"), ("nation", "n_name"), ("conversations", "text")]
    each = [table(spark, sf_dir, t).select(F.explode(F.split(F.lower(c), "[^a-z]+")).alias("word")) for t, c in sources]
    words = each[0].union(each[1]).union(each[2]).where("word <> ''").distinct()
    return words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


WORDS = "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(p_name), '[^a-z]+')) AS word FROM part UNION ALL SELECT unnest(string_split_regex(lower(n_name), '[^a-z]+')) FROM nation UNION ALL SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM conversations) WHERE word <> ''), u AS (SELECT word, upper(word) AS u FROM w)"
SQUEEZED = "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: i = 1 OR substr({0}, i, 1) <> substr({0}, i - 1, 1)), lambda i: substr({0}, i, 1)), '')"


@query(f"{WORDS}, r AS (SELECT word, u, replace(translate(u, 'AEIOUYWHBPFVCKSGJQXZDTLMNR', '000000DD112233344555667889'), 'D', '') AS c FROM u) SELECT word, substr(u, 1, 1) || {SQUEEZED.format('c')} AS code FROM r")
def soundex_refined(spark, sf_dir):
    """P15b."""
    return english_words(spark, sf_dir).select("word", phonetics.soundex_refined("word").alias("code"))


@query(f"{WORDS}, r AS (SELECT word, u, regexp_replace(substr(u, 2), '[AEIOUYWH]', '', 'g') AS c FROM u) SELECT word, rpad(substr(u, 1, 1) || translate(substr({SQUEEZED.format('c')}, 1, 4), 'DTMNLRBFPVCJKGQSXZ', '112233444455555555'), 4, '0') AS lein FROM r")
def lein_codes(spark, sf_dir):
    """P7."""
    return english_words(spark, sf_dir).select("word", phonetics.lein("word").alias("lein"))


@query(f"{WORDS}, r AS (SELECT word, u, regexp_replace(substr(u, 2), '[AEIOUY]', '', 'g') AS c FROM u) SELECT word, substr(substr(u, 1, 1) || {SQUEEZED.format('c')}, 1, 4) AS statcan FROM r")
def statcan_codes(spark, sf_dir):
    """P16."""
    return english_words(spark, sf_dir).select("word", phonetics.statcan("word").alias("statcan"))


@query()
def fonem_codes(spark, sf_dir):
    """P17."""
    return english_words(spark, sf_dir).select("word", phonetics.fonem("word").alias("fonem"))


@query(T.phonetic_rules(WORDS))
def phonetic_rules(spark, sf_dir):
    """Codes that are chains of rules."""
    kinds = ["caverphone", "metaphone", "nysiis", "soundex", "onca", "mra", "french_soundex", "soundex2", "french_phonex", "phonem"]
    return english_words(spark, sf_dir).select("word", *(getattr(phonetics, k)("word").alias(k) for k in kinds), phonetics.caverphone("word", revisited=True).alias("caverphone2"), phonetics.nysiis("word", refined=True).alias("nysiis_refined"))


@query()
def phonetic_kernels(spark, sf_dir):
    """Codes that walk a word."""
    kinds = ["alpha_sis", "daitch_mokotoff", "eudex", "fuzzy_soundex", "phonex", "roger_root", "sound_d", "cologne"]
    return english_words(spark, sf_dir).select("word", *(getattr(codes, f"{k}_column")("word").alias(k) for k in kinds), sonnex_column("word").alias("sonnex"))


@query()
def uea_stems(spark, sf_dir):
    """ST5."""
    return english_words(spark, sf_dir).select("word", english.uea_lite_column("word").alias("s")).select("word", "s.stem", "s.rule")


@query()
def eudex_pairs(spark, sf_dir):
    """Distances of the names' hashes."""
    n = names(spark, sf_dir).select("name", codes.eudex_column("name").alias("h"))
    pairs = n.select(F.col("name").alias("a"), F.col("h").alias("x")).join(n.select(F.col("name").alias("b"), F.col("h").alias("y")), F.expr("a < b"))
    return pairs.select("a", "b", metrics.eudex_distance("x", "y").cast("long").alias("distance"), metrics.eudex_similar("x", "y").alias("similar"))


@query(f"{WORDS} SELECT word, CASE WHEN len(word) < 3 OR word NOT LIKE '%s' OR regexp_matches(word, '[us]s$') THEN word WHEN len(word) > 3 AND regexp_matches(word, '[^ae]ies$') THEN left(word, len(word) - 3) || 'y' WHEN regexp_matches(word, '[iaoe]es$') THEN word ELSE left(word, len(word) - 1) END AS stem FROM w")
def s_stems(spark, sf_dir):
    """ST4."""
    return english_words(spark, sf_dir).select("word", stemmers.s_stemmer("word").alias("stem"))


@query(T.porter(WORDS))
def porter_stems(spark, sf_dir):
    """ST1."""
    return english_words(spark, sf_dir).select("word", stemmers.porter_column("word").alias("porter"))


@query(T.schinke(WORDS))
def schinke_stems(spark, sf_dir):
    """ST12."""
    return english_words(spark, sf_dir).select("word", stemmers.schinke_column("word").alias("s")).select("word", "s.noun", "s.verb")


@query(f"{WORDS} SELECT word, {T.SPANISH_UNINE} AS stem FROM w")
def spanish_unine_stems(spark, sf_dir):
    """ST13."""
    return english_words(spark, sf_dir).select("word", stemmers.spanish_unine_column("word").alias("stem"))


def french_words(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.explode(F.split(F.lower("text"), r"[^a-zà-öø-ÿœ]+")).alias("word"))
    return words.where("word <> ''").distinct()


@query(T.eda("WITH u AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-zà-öø-ÿœ]+')) AS word FROM documents WHERE lang = 'fr') WHERE word <> '')"))
def eda_stems(spark, sf_dir):
    """ST8: the words of French documents."""
    return french_words(spark, sf_dir).select("word", stemmers.eda_column("word").alias("stem"))


@query(f"{WORDS} SELECT word, {T.spanish_singular('word')} AS singular FROM w")
def spanish_singulars(spark, sf_dir):
    """I1."""
    return english_words(spark, sf_dir).select("word", stemmers.spanish_singular_column("word").alias("singular"))


@query()
def french_stems(spark, sf_dir):
    """ST9, ST10 of the words of French documents."""
    kinds = {"porter": french.french_porter_column, "unine": french.unine_complex_column, "unine_minimal": french.unine_minimal_column}
    return french_words(spark, sf_dir).select("word", *(f("word").alias(k) for k, f in kinds.items()))


@query()
def stems(spark, sf_dir):
    """ST2, ST11."""
    kinds = ["lancaster", "caumanns"]
    return english_words(spark, sf_dir).select("word", *(getattr(stemmers, f"{k}_column")("word").alias(k) for k in kinds))


@query()
def double_metaphones(spark, sf_dir):
    """P4."""
    return english_words(spark, sf_dir).select("word", F.array_join(double_metaphone_column("word"), "/").alias("codes"))


@query()
def sentence_and_tweet_words(spark, sf_dir):
    """Sentences, words by language and tweet words of documents and turns."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    by_lang = F.when(F.col("lang") == "en", segmenters.words_by_language("en", "text")).when(F.col("lang") == "fr", segmenters.words_by_language("fr", "text")).otherwise(segmenters.words_by_language("de", "text"))
    a = docs.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.size(segmenters.sentences_column("text")).cast("long").alias("sentences"), F.size(by_lang).cast("long").alias("words"))
    b = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("turn").alias("kind"), F.size(segmenters.sentences_column("text")).cast("long").alias("sentences"), F.size(segmenters.tweet_words_column("text")).cast("long").alias("words"))
    return a.union(b)


@query(f"{WORDS} SELECT regexp_extract(word, '^[^aeiouy]+') AS onset, count(*) AS count FROM w WHERE regexp_matches(word, '^[^aeiouy]') GROUP BY 1")
def onset_frequencies(spark, sf_dir):
    """What words begin with."""
    return segmenters.onsets(english_words(spark, sf_dir), "word")


@query()
def syllables(spark, sf_dir):
    """Words cut by sonority and by the onsets of the corpus, which are a few hundred."""
    words = english_words(spark, sf_dir)
    legal = [r.onset for r in segmenters.legal_onsets(segmenters.onsets(words, "word")).collect()]
    return words.select("word", F.array_join(segmenters.sonority_syllables_column("word"), "-").alias("sonority"), F.array_join(segmenters.onset_syllables_column("word", legal), "-").alias("onsets"))


# --- linkage ---------------------------------------------------------------------------------------------------------


def items(spark, sf_dir) -> DataFrame:
    """Distinct part names, with the least key of each as id."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


ITEMS = "WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1)"


def edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a["name"], b["name"])


CLOSE = linkage.Alike(distance=edit, radius=4)


@query(f"{ITEMS} SELECT x.id AS src, y.id AS dst FROM n x JOIN n y ON x.id < y.id AND levenshtein(x.name, y.name) <= 4")
def naive_pairs(spark, sf_dir):
    """C5."""
    return linkage.naive_pairs(items(spark, sf_dir), CLOSE)


@query(f"{ITEMS}, k AS (SELECT DISTINCT id, name, unnest(string_split(name, ' ')) AS key FROM n) SELECT DISTINCT x.id AS src, y.id AS dst FROM k x JOIN k y ON x.key = y.key AND x.id < y.id AND levenshtein(x.name, y.name) <= 4")
def blocking_pairs(spark, sf_dir):
    """Blocks are words."""
    return linkage.blocking_pairs(items(spark, sf_dir), F.split("name", " "), CLOSE)


@query(f"{ITEMS}, o AS (SELECT id, name, row_number() OVER (ORDER BY name, id) AS at FROM n) SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst FROM o x JOIN o y ON y.at BETWEEN x.at + 1 AND x.at + 3 WHERE levenshtein(x.name, y.name) <= 4")
def sorted_neighborhood_pairs(spark, sf_dir):
    """C7."""
    return linkage.snm_pairs(items(spark, sf_dir), [[F.asc("name")]], 3, CLOSE)


@query(f"{ITEMS} SELECT x.id AS src, y.id AS dst FROM n x JOIN n y ON x.id < y.id AND levenshtein(x.name, y.name) <= 4")
def metric_range_pairs(spark, sf_dir):
    """The range join."""
    return linkage.metric_range_pairs(items(spark, sf_dir), edit, 4)


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT x.vec_id AS src, y.vec_id AS dst, list_cosine_similarity(x.v, y.v) AS s FROM e x JOIN e y ON x.vec_id <> y.vec_id) SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(s, 6) AS similarity FROM (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM p) WHERE rank <= 3")
def exact_nearest(spark, sf_dir):
    """The exact graph of the three nearest vectors."""
    knn = linkage.exact_vector_knn(table(spark, sf_dir, "embeddings"), "embedding", 3, "vec_id")
    return knn.select("src", "rank", "dst", F.round("similarity", 6).alias("similarity"))


@query()
def nn_descent_graph(spark, sf_dir):
    """The approximate graph of names."""
    return linkage.nn_descent(items(spark, sf_dir), lambda a, b: metrics.jaccard(a["name"], b["name"]), 5)


@query("SELECT TRUE AS enough")
def nn_descent_recall(spark, sf_dir):
    """Whether the approximate graph of names has nine tenths of the similarity that the exact one has."""
    near = lambda a, b: metrics.jaccard(a["name"], b["name"])
    n = items(spark, sf_dir)
    total = lambda g: g.agg(F.sum("similarity").alias("s"))
    found, exact = total(linkage.nn_descent(n, near, 5)), total(linkage.exact_knn(n, near, 5))
    return found.crossJoin(exact.withColumnRenamed("s", "most")).select((F.col("s") >= 0.9 * F.col("most")).alias("enough"))  # one row each


EDGES = f"{ITEMS}, e AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id < y.id AND levenshtein(x.name, y.name) <= 4)"


@query(T.stars(EDGES))
def naive_clusters(spark, sf_dir):
    """Star clusters of names."""
    return linkage.naive(items(spark, sf_dir), CLOSE)


@query(T.stars(EDGES))
def range_clusters(spark, sf_dir):
    """Star clusters of names by the range join."""
    return linkage.vp_tree(items(spark, sf_dir), edit, 4)


@query(T.stars(f"{ITEMS}, k AS (SELECT DISTINCT id, name, unnest(string_split(name, ' ')) AS key FROM n), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id < y.id AND levenshtein(x.name, y.name) <= 4)"))
def blocking_clusters(spark, sf_dir):
    """Star clusters of names in blocks of a word."""
    return linkage.blocking(items(spark, sf_dir), F.split("name", " "), CLOSE)


@query(T.stars(f"{ITEMS}, o AS (SELECT id, name, row_number() OVER (ORDER BY name, id) AS at FROM n), e AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM o x JOIN o y ON y.at BETWEEN x.at + 1 AND x.at + 3 WHERE levenshtein(x.name, y.name) <= 4)"))
def sorted_clusters(spark, sf_dir):
    """Star clusters of names next to each other."""
    return linkage.sorted_neighborhood(items(spark, sf_dir), [[F.asc("name")]], 3, CLOSE)


@query(T.stars(f"{ITEMS}, k AS (SELECT DISTINCT id, {T.soundex('v')} AS key FROM (SELECT id, unnest(string_split(upper(name), ' ')) AS v FROM n)), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id < y.id)"))
def key_collision_merged(spark, sf_dir):
    """Names that share a sound of a word, merged."""
    n = items(spark, sf_dir)
    return linkage.key_collision_merged(n, F.transform(F.split("name", " "), lambda w: phonetics.soundex(w)))


FOLD = "list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ids, lambda i: [i])), lambda acc, i: CASE WHEN len(list_filter(acc, lambda h: list_contains(pairs, h * 10000000 + i[1]))) > 0 THEN acc ELSE list_concat(acc, i) END)"
PLACES = "SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1 AS INTEGER) AS pos, id FROM m"


@query(f"{ITEMS}, e AS (SELECT x.id AS a, y.id AS b, levenshtein(x.name, y.name) AS d FROM n x JOIN n y ON x.id < y.id), l AS (SELECT unnest({FOLD}) AS id FROM (SELECT list(id ORDER BY id) AS ids FROM n), (SELECT list(a * 10000000 + b) AS pairs FROM e WHERE d <= 3)), gone AS (SELECT id, min(h) AS h FROM (SELECT id, id AS h FROM l UNION ALL SELECT b, a FROM e JOIN l ON l.id = a WHERE d <= 3) GROUP BY id), m AS (SELECT id AS cluster_id, id FROM l UNION ALL SELECT a, b FROM e JOIN l ON l.id = a LEFT JOIN gone ON gone.id = b WHERE d <= 6 AND (h IS NULL OR h >= a)) {PLACES}")
def canopy_clusters(spark, sf_dir):
    """C3."""
    return linkage.canopy(items(spark, sf_dir), edit, 6, 3)


@query(f"{ITEMS}, e AS (SELECT x.id AS a, y.id AS b, levenshtein(x.name, y.name) AS d FROM n x JOIN n y ON x.id < y.id), l AS (SELECT unnest({FOLD}) AS id FROM (SELECT list(id ORDER BY id) AS ids FROM n), (SELECT list(a * 10000000 + b) AS pairs FROM e WHERE d <= 5)), m AS (SELECT id AS cluster_id, id FROM l UNION ALL SELECT arg_min(a, d * 10000000 + a), b FROM e JOIN l ON l.id = a WHERE d <= 5 GROUP BY b) {PLACES}")
def leader_clusters(spark, sf_dir):
    """C4."""
    return linkage.leader(items(spark, sf_dir), edit, 5)


# --- keywords and markup -----------------------------------------------------------------------------------------------


STOPS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "be", "by", "was", "with", "as", "at", "re"]


RAKE = "WITH t AS (SELECT conv_id * 1000 + turn AS doc, text FROM conversations), s AS (SELECT doc, i AS sent, string_split_regex(l[i], ' +') AS w FROM (SELECT doc, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc, string_split(lower(text), chr(10)) AS l FROM t))), w AS (SELECT doc, sent, p, w[p] AS word FROM (SELECT doc, sent, w, unnest(range(1, len(w) + 1)) AS p FROM s)), m AS (SELECT *, word IN ('" + "','".join(STOPS) + "') OR regexp_matches(word, '^[^A-Za-z0-9_\\s]+$') AS stop FROM w), r AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc, sent ORDER BY p) AS run, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc, sent) AS stops FROM m), c AS (SELECT doc, sent, run, word, count(*) OVER (PARTITION BY doc, sent, run) AS size FROM r WHERE NOT stop AND run < stops), f AS (SELECT doc, word, count(*) AS frequency FROM m WHERE NOT stop GROUP BY 1, 2), d AS (SELECT doc, word, CAST(sum(size - 1) AS BIGINT) AS degree FROM c GROUP BY 1, 2)"


@query(f"{RAKE} SELECT f.doc, f.word, frequency, coalesce(degree, 0) AS degree FROM f LEFT JOIN d ON f.doc = d.doc AND f.word = d.word")
def rake_word_scores(spark, sf_dir):
    """K1: words of turns with their frequency and degree."""
    words = rake.rake_words(*rake_input(spark, sf_dir))
    return rake.rake_word_scores(words)


def rake_input(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.transform(F.split(lowered("text"), "\n"), lambda x: F.split(x, " +")).alias("sentences"))
    return turns, spark.createDataFrame([(w,) for w in STOPS], "word string")


KEYWORDS = (
    "ph AS (SELECT DISTINCT doc, words FROM (SELECT doc, sent, run, list(word ORDER BY p) AS words FROM (SELECT doc, sent, run, word, p FROM r WHERE NOT stop AND run < stops) GROUP BY ALL)), "
    "sc AS (SELECT f.doc, f.word, coalesce(degree, 0) / frequency AS s FROM f LEFT JOIN d ON f.doc = d.doc AND f.word = d.word), "
    "pw AS (SELECT doc, words, unnest(words) AS word FROM ph), v AS (SELECT pw.doc, pw.words, sum(s) AS score FROM pw JOIN sc ON pw.doc = sc.doc AND pw.word = sc.word GROUP BY ALL), "
    "k AS (SELECT doc, words, score, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, array_to_string(words, ' ')) AS rank, count(*) OVER (PARTITION BY doc) AS n FROM v)"
)


@query(f"{RAKE}, {KEYWORDS} SELECT doc, CAST(rank AS INTEGER) AS rank, array_to_string(words, ' ') AS keyword, round(score, 6) AS score FROM k WHERE rank <= n // 3")
def rake_keywords(spark, sf_dir):
    """K1."""
    return rake.rake(*rake_input(spark, sf_dir)).select("doc", "rank", F.array_join("keyword", " ").alias("keyword"), F.round("score", 6).alias("score"))


@query()
def punkt_sentences(spark, sf_dir):
    """Sentences of documents under a model trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return punkt.split(docs, punkt.learn(docs)).select("doc_id", F.size("sentences").cast("long").alias("sentences"))


@query()
def html_texts(spark, sf_dir):
    """S3."""
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(parsers.html_text("html")).cast("long").alias("n_chars"))


@query("SELECT doc_id, word, tag FROM (SELECT item_id AS doc_id, unnest(string_split_regex(trim(text), '\\s+')) AS word, 'w' AS tag FROM benchmark) WHERE word NOT LIKE '%/%' AND word <> ''")
def tagged_words(spark, sf_dir):
    """Words of the benchmark, tagged and parsed again."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(parsers.brown(F.regexp_replace("text", r"(\S+)", "$1/w"))).alias("t"))
    return b.select("doc_id", "t.word", "t.tag").where("NOT word LIKE '%/%' AND tag = 'w'")
