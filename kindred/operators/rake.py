"""RAKE keyword extraction as a relational plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = r"^[^A-Za-z0-9_\t\n\f\r ]+\z"
PLACES = 6  # to which scores are compared


def rake_words(docs: DataFrame, stopwords: DataFrame, doc: str = "doc", sentences: str = "sentences") -> DataFrame:
    """(doc, sent, pos, word, stop) of documents that are arrays of sentences of tokens; stop: a stop word or punctuation.

    stopwords: (word); its size decides how Spark joins it.
    """
    words = docs.select(F.col(doc).alias("doc"), F.posexplode(sentences).alias("sent", "tokens")).select("doc", "sent", F.posexplode("tokens").alias("pos", "word"))
    stops = stopwords.select("word", F.lit(True).alias("listed")).distinct()
    return words.join(stops, "word", "left").select("doc", "sent", "pos", "word", (F.col("listed").isNotNull() | F.col("word").rlike(PUNCTUATION)).alias("stop"))


def rake_candidates(words: DataFrame) -> DataFrame:
    """(doc, sent, run, words): runs of words that a stop word or punctuation ends; a sentence's last run, which none
    ends, is no candidate."""
    order = Window.partitionBy("doc", "sent").orderBy("pos")
    runs = words.withColumn("run", F.sum(F.col("stop").cast("int")).over(order))
    ends = words.where("stop").groupBy("doc", "sent").agg(F.count("*").alias("stops"))
    runs = runs.where("NOT stop").join(ends, ["doc", "sent"], "left").where("run < stops")
    return runs.groupBy("doc", "sent", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))


def rake_word_scores(words: DataFrame) -> DataFrame:
    """(doc, word, frequency, degree): how often a word is there, and with how many others it stands in candidates."""
    freq = words.where("NOT stop").groupBy("doc", "word").agg(F.count("*").alias("frequency"))
    degree = rake_candidates(words).select("doc", F.explode("words").alias("word"), (F.size("words") - 1).alias("d")).groupBy("doc", "word").agg(F.sum("d").alias("degree"))
    return freq.join(degree, ["doc", "word"], "left").select("doc", "word", "frequency", F.coalesce("degree", F.lit(0)).alias("degree"))


def rake(docs: DataFrame, stopwords: DataFrame, doc: str = "doc", sentences: str = "sentences") -> DataFrame:
    """(doc, rank, keyword, score): a document's best third of distinct candidates by the sum of their words' degree
    over frequency; ties by the words themselves. Sums that differ only in how fractions were rounded or added up are
    ties: scores are compared to PLACES places."""
    words = rake_words(docs, stopwords, doc, sentences)
    scores = rake_word_scores(words).select("doc", "word", (F.col("degree") / F.col("frequency")).alias("s"))
    own = rake_candidates(words).select("doc", "words").distinct()
    each = own.select("doc", "words", F.explode("words").alias("word")).join(scores, ["doc", "word"])
    scored = each.groupBy("doc", "words").agg(F.sum("s").alias("score"))
    most = own.groupBy("doc").agg(F.floor(F.count("*") / 3).alias("most"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.round("score", PLACES)), F.array_join("words", " ")))
    return scored.withColumn("rank", rank).join(most, "doc").where("rank <= most").select("doc", "rank", F.col("words").alias("keyword"), "score")
