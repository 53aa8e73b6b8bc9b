"""Sentences, tweets, words and syllables: kernels, trained onsets, and their columns."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DOUBLE_QUOTES, SINGLE_QUOTES, by_rules, col
from .udfs import kernel_column

# Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("Dr", "etc", "Jr", "M", "Mgr", "Mr", "Mrs", "Ms", "Mme", "Mlle", "Prof", "Sr", "St", "p", "pp")
QUOTES, SINGLES = re.escape(DOUBLE_QUOTES), re.escape(SINGLE_QUOTES)
BREAK = re.compile(rf"([.?!…]+)([{QUOTES}*_]?[*_]?)\s+(?=[{QUOTES}{SINGLES}]?[_*\[]*[A-Z0-9À-Ü])")


def sentences(text: str, exceptions: Iterable[str] = ABBREVIATIONS) -> list[str]:
    """Cut after final marks before a capital or digit, but not after an abbreviation or list mark, nor inside quotes
    or brackets. Without exceptions nothing counts as an abbreviation."""
    parts = BREAK.sub("\\1\\2\x1e", text).split("\x1e")
    short = re.compile("|".join(f"{e}\\." for e in exceptions)) if exceptions else None
    odd = lambda s: sum(c in DOUBLE_QUOTES for c in s) % 2 or sum(c in "(){}[]" for c in s) % 2
    out, held = [], ""
    for k, part in enumerate(parts):
        joins = bool(short and short.search(part)) or bool(re.match(r"[A-Z0-9]\s?[.]\s*$", part))
        joins = joins or (not re.match(r"[A-Za-z0-9]\s*\)", part) and odd(held + part))
        if joins and k < len(parts) - 1:
            held += (" " if held else "") + part
        else:
            out.append(held + (" " if part and held else "") + part)
            held = ""
    return out


# What counts as one word in a tweet, in the order in which it is looked for.
FACE = r"[)\](\[dDpP/:}{@|\\]"
TWEET_PARTS = [
    r"(?:https?:(?:/{1,3}|[a-z0-9%])|[a-z0-9.\-]+[.](?:[a-z]{2,13})/)(?:[^\s()<>{}\[\]]+|\([^\s()]*?\([^\s()]+\)[^\s()]*?\)|\([^\s]+?\))+(?:\([^\s()]*?\([^\s()]+\)[^\s()]*?\)|\([^\s]+?\)|[^\s`!()\[\]{};:'\".,<>?«»“”‘’])",
    r"(?:[a-z0-9]+(?:[.\-][a-z0-9]+)*[.](?:[a-z]{2,13})\b/?(?!@))",
    r"(?:(?:\+?[01][\-\s.]*)?(?:[(]?\d{3}[\-\s.)]*)?\d{3}[\-\s.]*\d{4})",
    rf"(?:[<>]?[:;=8][\-o*']?{FACE}|{FACE}[\-o*']?[:;=8][<>]?|<3)",
    r"<[^>\s]+>", r"[\-]+>|<[\-]+", r"(?:@\w+)", r"(?:#+\w+[\w'\-]*\w+)", r"[\w.+-]+@[\w-]+\.(?:[\w-]\.?)+[\w-]",
    r"(?:[+\-]?d+[,/.:-]\d+[+\-]?)", r"\w+", r"(?:\.(?:\s*\.)+)", r"\S",
]
TWEET = re.compile("|".join(TWEET_PARTS), re.I | re.A)


def tweet_words(tweet: str) -> list[str]:
    """Words of a tweet: addresses, faces, names and tags are words; four or more of a mark count as three."""
    return TWEET.findall(re.sub(r"([^a-zA-Z0-9])\1{3,}", r"\1\1\1", html.unescape(tweet)))


# Contractions in the languages that the word tokenizer tells apart.
ENGLISH = [("([^\\p{L}])(['’])([^\\p{L}])", "$1 $2 $3"), ("([^\\p{L}\\p{N}])(['’])(\\p{L})", "$1 $2 $3"), ("(\\p{L})(['’])([^\\p{L}])", "$1 $2 $3"), ("(\\p{L})(['’])(\\p{L})", "$1 $2$3"), ("(\\p{N})(['’])s", "$1 $2s")]
SOMALI = [("([^\\p{L}])(['’])([^\\p{L}])", "$1 $2 $3"), ("([^\\p{L}])(['’])(\\p{L})", "$1 $2 $3"), ("(\\p{L})(['’])([^\\p{L}])", "$1 $2 $3")]
LATIN = [*SOMALI, ("(\\p{L})(['’])(\\p{L})", "$1$2 $3")]
FRENCH = [("(?i)aujourd(['’])\\s+hui", "aujourd$1hui"), ("(?i)presqu(['’])\\s+([iî]le)", "presqu$1$2")]
CONTRACTIONS = {"en": ENGLISH, "fr": [*LATIN, *FRENCH], "it": LATIN, "ga": LATIN, "so": SOMALI}
KEPT = "\x02"  # stands for the point of an abbreviation meanwhile


def words_by_language(lang: str, c) -> Column:
    """Words with punctuation set apart and contractions cut as a language (ISO 639-1) does."""
    short = "(?:\\p{Lu}\\.){2,}|(?:" + "|".join(ABBREVIATIONS) + ")\\."
    out = by_rules(col(c), [("^\\s+|\\s+$", ""), ("[\\r\\n]+", " "), ("[\\x00-\\x1f]", ""), ("\\s+", " ")])
    # points inside abbreviations are marked one by one, from the abbreviation's first
    for _ in range(6):
        out = F.regexp_replace(out, f"((?:^|\\s)(?:\\p{{Lu}}{KEPT})*\\p{{Lu}})\\.(?=\\p{{Lu}}\\.|(?<=\\p{{Lu}}{KEPT}\\p{{Lu}}\\.))", f"$1{KEPT}")
    out = F.regexp_replace(out, "((?:^|\\s)(?:" + "|".join(ABBREVIATIONS) + "))\\.", f"$1{KEPT}")
    apart = "([^\\p{L}\\p{N}\\s.'’`,\\-:" + KEPT + "])" if lang in ("fi", "sv") else "([^\\p{L}\\p{N}\\s.'’`,\\-" + KEPT + "])"
    out = by_rules(out, [(apart, " $1 "), ("([^\\p{N}]),", "$1 , "), (",([^\\p{N}])", " , $1"), ("\\.(\\s*)$", " .$1"), ("([\\p{Ll}\\p{N}])\\. (?=\\p{Lu})", "$1 . ")])
    out = by_rules(out, CONTRACTIONS.get(lang, [("(['’])", " $1 ")]))
    out = F.replace(by_rules(out, [("^\\s+|\\s+$", ""), ("\\s+", " ")]), F.lit(KEPT), F.lit("."))
    return F.split(out, " ")


# Letters from the most to the least sonorous.
SONORITY = ("aeiouy", "lmnrw", "zvsf", "bcdgtkpqxhj")


def sonority_syllables(word: str, hierarchy: tuple[str, ...] = SONORITY) -> list[str]:
    """Cut a word where sonority is least; parts without a vowel go to the one before."""
    level = {c: len(hierarchy) - k - 1 for k, group in enumerate(hierarchy) for c in group}
    bare = re.sub("^[.:;?!()'\"]+|[.:;?!()'\"]+$", "", word)
    if sum(c.lower() in hierarchy[0] for c in bare) <= 1:
        return [word]
    value = [level.get(c, 0) for c in bare]
    parts, part = [], bare[0]
    for i in range(1, len(bare) - 1):
        here, before, after = value[i], value[i - 1], value[i + 1]
        if here == after and here <= before:
            parts, part = [*parts, part + bare[i]], ""
        elif here < after and here < before:
            parts, part = [*parts, part], bare[i]
        else:
            part += bare[i]
    out: list[str] = []
    front = ""
    for p in [*parts, part + bare[-1]]:
        if not set(p) & set(hierarchy[0]):
            front, out = (front, [*out[:-1], out[-1] + p]) if out else (front + p, out)
        else:
            out.append(p if out else front + p)
    return out


VOWELS = "aeiouy"
ONSET_SHARE = 0.0002  # fixed value: the share of all onsets above which one is legal


def onsets(words: DataFrame, column: str) -> DataFrame:
    """(onset, count) of a column of words: the consonants that they begin with."""
    bare = F.regexp_replace(F.lower(column), "[^a-zà-öø-ÿ]", "")
    onset = F.regexp_extract(bare, f"^[^{VOWELS}]+", 0)
    return words.select(onset.alias("onset")).where("onset <> ''").groupBy("onset").agg(F.count("*").alias("count"))


def legal_onsets(counts: DataFrame) -> DataFrame:
    """(onset) of those common enough, with the last two and three letters of longer ones."""
    total = counts.agg(F.sum("count").alias("__total"))  # one row
    common = counts.crossJoin(F.broadcast(total)).where(F.col("count") / F.col("__total") > ONSET_SHARE).select("onset")
    ends = [common.where(F.length("onset") > n).select(F.expr(f"right(onset, {n})").alias("onset")) for n in (2, 3)]
    return common.union(ends[0]).union(ends[1]).distinct()


def onset_syllables(word: str, legal: frozenset[str] = frozenset()) -> list[str]:
    """Cut a word so that syllables begin with legal onsets, from its end on."""
    if sum(c in VOWELS for c in word.lower()) <= 1:
        return [word]
    parts: list[str] = []
    part, starts, fresh = "", False, True
    for c in reversed(word):
        low, done = c.lower(), part.lower()
        if fresh:
            part = c + done
            fresh = low not in VOWELS
        elif not done:
            part = c
        elif any(low + done[:k] in legal and done[k : k + 1] in tuple(VOWELS) for k in range(4)):
            part, starts = c + done, True
        elif low in VOWELS and not starts:
            part = c + done
        else:
            parts.append(done)
            part, fresh = c, low not in VOWELS
    return [part, *reversed(parts)]


def _column(kernel, c, **options) -> Column:
    return kernel_column(kernel, "array<string>", c, **options)


sentences_column = partial(_column, sentences)
tweet_words_column = partial(_column, tweet_words)
sonority_syllables_column = partial(_column, sonority_syllables)


def onset_syllables_column(c, legal: Iterable[str]) -> Column:
    """legal: the onsets that legal_onsets() found; there are a few hundred in a language."""
    return kernel_column(partial(onset_syllables, legal=frozenset(legal)), "array<string>", c)
