"""Texts that hold tagged tokens, and text out of HTML, as Column expressions and readers."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import col
from kindred.functions.udfs import kernel_column


def brown(c) -> Column:
    """word/tag pairs separated by white space, as an array of (word, tag); a word has no slash."""
    pattern = r"([^/\s]+)/(\S+)"
    words, tags = (F.regexp_extract_all(col(c), F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))


def conll(c) -> Column:
    """Lines of word, part of speech and chunk; blank lines end sentences: an array of sentences of (word, pos, chunk)."""
    sentences = F.filter(F.split(col(c), "\n(?:[ \t]*\n)+"), lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" "))) != "")
    token = lambda p: F.struct(F.get(p, F.lit(0)).alias("word"), F.get(p, F.lit(1)).alias("pos"), F.get(p, F.lit(2)).alias("chunk"))
    lines = lambda s: F.filter(F.split(s, "\n"), lambda x: F.trim(x) != "")
    return F.transform(sentences, lambda s: F.transform(lines(s), lambda x: token(F.split(x, " "))))


def read_brown(spark: SparkSession, path: str) -> DataFrame:
    """(path, word, tag) of files of tagged text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(brown("value")).alias("t"))
    return files.select("path", "t.word", "t.tag")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, pos, word, tag, chunk) of files of chunked text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(conll("value")).alias("sentence", "tokens"))
    return files.select("path", "sentence", F.posexplode("tokens").alias("pos", "t")).select("path", "sentence", "pos", "t.word", F.col("t.pos").alias("tag"), "t.chunk")


MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|</?[A-Za-z_](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)


def strip_markup(source: str) -> str:
    """Text outside tags, comments, scripts and styles, with character references decoded; nothing in place of tags."""
    return html.unescape(MARKUP.sub("", source))


def html_text(c) -> Column:
    return kernel_column(strip_markup, "string", c)
