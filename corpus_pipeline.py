"""From raw documents to packed training sequences: quality, near copies, repeated passages, packing.

Every stage works on all that the one before it kept, written as Parquet. All but the last return the columns of
documents; the last returns the pieces of sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm._shared import Scratch
from kindred.llm.minhash_dedup import minhash_dedup
from kindred.llm.packing import pack
from kindred.llm.quality import quality_classifier
from kindred.llm.substring_dedup import substring_dedup
from kindred.plans.scratch import passing


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, accepts."""
    scored = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return minhash_dedup(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 words that occur more than once; texts left without a word go.

    Texts that lose nothing stay as they are; others are their kept words joined by one space, and n_chars follows.
    """
    out = substring_dedup(docs, prefix="__")
    text = F.when(F.col("__n_removed") > 0, F.col("__kept_text")).otherwise(F.col("text"))
    out = out.where("NOT (__n_removed > 0 AND __n_removed = __n_words)").withColumn("text", text)
    n_chars = F.when(F.col("__n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from public_tokenizers import path

    return pack(docs, path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("packing", packed),
]

#: The stages are a learnt model, a randomised index and a tokenizer, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next; what a stage kept beside goes with it."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with passing():
            docs = scratch.freeze(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
