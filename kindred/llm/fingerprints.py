"""Document fingerprints by consistent weighted sampling, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions

SAMPLES, GROUP = 48, 4  # samples in a signature; samples drawn in one generated method, which the JVM must find small enough
WORDS = r"[\x20\x09-\x0D]+"


def draws(i: int) -> dict[str, Column]:
    """For the i-th sample of a row's group: r and c from Gamma(2, 1), as minus the log of two uniforms, and b uniform.

    They follow from the term and the sample alone, so all documents draw the same ones.
    """
    bits = F.xxhash64("term", "group", F.lit(i))
    uniform = lambda at: (F.shiftrightunsigned(bits, at).bitwiseAND(8191).cast("double") + 0.5) * 2.0**-13
    return {
        f"r{i}": -F.log(uniform(0) * uniform(13)),
        f"log_c{i}": F.log(-F.log(uniform(26) * uniform(39))),
        f"b{i}": (F.shiftrightunsigned(bits, 52).cast("double") + 0.5) * 2.0**-12,
    }


def least(i: int, log_weight: str) -> Column:
    """The sample: the term, and the step t of its weight, for which log a = log c - r (t - b + 1) is least.

    The least of a long whose high half is log a, scaled, and whose low half names term and step.
    """
    r, log_c, b = (F.col(f"{x}{i}") for x in ("r", "log_c", "b"))
    t = F.floor(F.col(log_weight) / r + b)
    rank = ((log_c - r * (t - b + 1) + 64) * 2.0**24).cast("long")
    name = F.col("term").bitwiseXOR(F.shiftleft(t, 25)).bitwiseAND(0xFFFFFFFF)
    return F.min(F.shiftleft(rank, 32).bitwiseOR(name))


def signatures(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each row of texts (by its keys, on which it should be partitioned) the signature of each of some columns.

    A signature is a string of SAMPLES hex words of 8 digits; texts without a word have the empty one.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(c).alias("text")) for k, c in enumerate(columns))))
    words = texts.select(*keys, each.alias("e")).select(*keys, "e.which", F.explode(F.split("e.text", WORDS)).alias("word")).where("word <> ''")
    count = lambda k: F.log(F.nullif(F.sum(F.when(F.col("which") == k, 1.0).otherwise(0.0)), F.lit(0.0)))
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*(count(k).alias(f"w{k}") for k in range(len(columns))))
    rows = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))).alias("group"))
    drawn = rows.select(*keys, "group", "term", *(f"w{k}" for k in range(len(columns))), *(c.alias(n) for i in range(GROUP) for n, c in draws(i).items()))
    best = drawn.groupBy(*keys, "group").agg(*(least(i, f"w{k}").alias(f"s{k}_{i}") for k in range(len(columns)) for i in range(GROUP)))
    hexed = lambda k: F.concat(*(F.lpad(F.lower(F.hex(F.col(f"s{k}_{i}").bitwiseAND(0xFFFFFFFF))), 8, "0") for i in range(GROUP)))
    parts = best.select(*keys, "group", *(hexed(k).alias(f"h{k}") for k in range(len(columns))))
    whole = lambda k: F.concat(*(F.coalesce(F.max(F.when(F.col("group") == g, F.col(f"h{k}"))), F.lit("")) for g in range(SAMPLES // GROUP)))
    return parts.groupBy(*keys).agg(*(whole(k).alias(columns[k]) for k in range(len(columns))))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two signatures have in common: an estimate of generalised Jaccard similarity.

    Two empty ones are alike (1); an empty one and another are not (0).
    """
    same = sum((F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(SAMPLES))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / float(SAMPLES))


NO_ID = -(1 << 63)  # stands for a missing id, so that joins stay plain; it sorts last, as nulls do


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, twin, text) dealt by id: equal ids are told apart by a number, in the order of a hash of their texts."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    twin = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"))).cast("long")
    return source.repartition(3 * partitions(docs.sparkSession), "id").withColumn("twin", twin)


def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on id and twin that asks for rows dealt by id alone, as they are."""
    other = right.withColumnsRenamed({"id": "__id", "twin": "__twin"})
    return left.join(other, F.expr("id = __id AND twin BETWEEN __twin AND __twin"), how).drop("__id", "__twin")


def next_rows(scratch: Scratch, ids: DataFrame) -> DataFrame:
    """(id, twin, n, next_id, next_twin) from (id, twin, n): the next row by descending id, then twin; the first after the last.

    Rows are dealt into ranges and written; inside a range the next row is a window's lead, and the last row of a range
    is followed by the first of the next one, for which one row a range is enough.
    """
    order = [F.desc("id"), F.asc("twin")]
    ranges = scratch.freeze(ids.repartitionByRange(partitions(ids.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = ranges.withColumn("next", F.lead(F.struct("id", "twin")).over(inside)).withColumn("at", F.row_number().over(inside))
    rows = scratch.freeze(rows, "leads")
    line = Window.orderBy("part")
    first = rows.where("at = 1").select("part", F.struct("id", "twin").alias("first"))
    start = F.first("first").over(line.rowsBetween(Window.unboundedPreceding, 0))
    follow = first.select("part", F.coalesce(F.lead("first").over(line), start).alias("follow"))
    out = rows.join(F.broadcast(follow), "part").withColumn("next", F.coalesce("next", "follow"))  # one row a range
    return scratch.freeze(out.select("id", "twin", "n", F.col("next.id").alias("next_id"), F.col("next.twin").alias("next_twin")), "order")


def with_edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(id, twin, n, text, edited): the last third of the characters replaced by the first as many of the next row."""
    want = order.select(F.col("next_id").alias("id"), F.col("next_twin").alias("twin"), F.col("id").alias("to_id"), F.col("twin").alias("to_twin"), F.floor(F.col("n") / 3).cast("int").alias("third"))
    sent = matched(rows, want).select(F.col("to_id").alias("id"), F.col("to_twin").alias("twin"), "third", F.expr("substring(text, 1, third)").alias("tail"))
    n = F.char_length("text")
    head = F.expr("substring(text, 1, char_length(text) - third)")
    return matched(rows, sent).select("id", "twin", n.cast("long").alias("n"), "text", F.concat(head, "tail").alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text.

    A document's terms are its words (runs of anything but space and \\t\\n\\v\\f\\r), weighted by how often they occur.
    For each of SAMPLES samples every weighted term draws consistently from gamma distributions, and the least draw
    names the sample, so that two documents agree on a sample with a probability of their generalised Jaccard
    similarity (sum of smaller weights over sum of larger ones); likeness() counts agreements.

    Null text: as empty, whose fingerprint is the empty string, like that of texts without words. Repeated rows get
    equal fingerprints; an empty table gives an empty result; other columns are not looked at.
    """
    rows = numbered(docs, id_col, text_col)
    signed = signatures(rows, ["id", "twin"], ["text"]).withColumnRenamed("text", "fingerprint")
    out = matched(rows.select("id", "twin"), signed, "left")
    return out.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and an edited form of it, and compare them; a check of how fingerprints follow edits.

    The edited form replaces the last third of the characters (rounded down) by the first as many, or all, of the
    document with the next smaller id; the largest id's, for the smallest. Rows that share an id follow each other by a
    hash of their text, rows without an id come last, and a single row is its own next. Otherwise as fingerprints().

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the
    edited form and to the next document's text).
    """
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    order = next_rows(scratch, rows.select("id", "twin", F.char_length("text").cast("long").alias("n")))
    both = with_edited(rows, order)
    signed = signatures(both, ["id", "twin"], ["text", "edited"])
    digests = both.select("id", "twin", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    found = matched(digests, signed, "left").select("id", "twin", "n", "sha", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "edited")))
    found = scratch.freeze(found, "found")
    follow = found.select(F.col("id").alias("next_id"), F.col("twin").alias("next_twin"), F.col("text").alias("follow"))
    out = found.join(order.select("id", "twin", "next_id", "next_twin"), ["id", "twin"]).join(follow, ["next_id", "next_twin"])
    return out.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("text").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("follow")).alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
