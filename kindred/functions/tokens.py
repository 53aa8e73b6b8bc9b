"""Tokenizers as Column expressions: a text becomes an array."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import ngrams
from .text import by_rules, col, deburr, findall, squeeze

# Characters dropped from fingerprints, and words left out of name fingerprints.
DROPPED = r"[ -⁯⸀-⹿'!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~\x00-\x08\x0A-\x1F\x7F]"
NAME_STOPWORDS = "the le la da di of doctor dr esq mgr professor prof md phd sir lord mr mrs ms mme mlle jr junior sr senior".split()
NAME_RULES = [(r"\bmc(?=\w)", "mac"), (r"\b(ma?c\s+)(?=\w)", "mac"), (r"\blee\b", "li"), (r"ski\b", "sky"), (r"\bvan\b", "von"), ("ö", "oe"), ("ü", "ue")]
TREEBANK_STARTS = [('^"', "``"), ("(``)", " $1 "), (r'([ (\[{<])"', "$1 `` ")]
TREEBANK_MARKS = [(r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), ("[;@#$%&]", " $0 "), (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "), ("[?!]", " $0 "), ("([^'])' ", "$1 ' ")]
TREEBANK_BRACKETS = [(r"[\]\[(){}<>]", " $0 "), ("--", " -- ")]
TREEBANK_ENDS = [('"', " '' "), (r"(\S)('')", "$1 $2 "), ("([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ")]
TREEBANK_CONTRACTIONS = [
    (r"(?i)\b(can)(not)\b", " $1 $2 "), (r"(?i)\b(d)('ye)\b", " $1 $2 "), (r"(?i)\b(gim)(me)\b", " $1 $2 "), (r"(?i)\b(gon)(na)\b", " $1 $2 "), (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "), (r"(?i)\b(mor)('n)\b", " $1 $2 "), (r"(?i)\b(wan)(na) \"", " $1 $2 "), (r"(?i) ('t)(is)\b", " $1 $2 "), (r"(?i) ('t)(was)\b", " $1 $2 "),
]


def fingerprint_tokens(c, digits: bool = True, min_token_size: int = 1, ngrams: int | None = None, sort: bool = True, split: list[str] | None = None, stopwords: list[str] | None = None) -> Column:
    """Distinct words (or n-grams) of a text in lower case without marks, punctuation and controls; sorted by default."""
    out = col(c)
    if split:
        out = F.regexp_replace(out, "[" + "".join(re.escape(s) for s in split) + "]", " ")
    if stopwords:
        out = F.regexp_replace(out, "(?i)(?:" + "|".join(rf"\b{re.escape(w)}\b" for w in stopwords) + ")", "")
    if not digits:
        out = F.regexp_replace(out, r"\d", "")
    out = F.lower(out)
    if min_token_size > 1:
        out = F.regexp_replace(out, rf"\b\S{{1,{min_token_size}}}\b", "")
    out = F.trim(deburr(F.regexp_replace(out, DROPPED, "")))
    out = by_rules(out, [(r"^\s+|\s+$", "")])
    tokens = F.array_distinct(F.split(out, r"\s+") if not ngrams else _grams(F.regexp_replace(out, r"\s+", ""), ngrams))
    return F.array_sort(tokens) if sort else tokens


def _grams(c: Column, n: int) -> Column:
    return ngrams(c, n)


def name_tokens(c) -> Column:
    """Words of a name, common spellings united, titles dropped, runs of a letter once."""
    name = by_rules(F.lower(col(c)), NAME_RULES)
    return F.transform(fingerprint_tokens(name, digits=False, split=["-"], stopwords=NAME_STOPWORDS), squeeze)


def bigrams(c, array: bool = False) -> Column:
    return ngrams(c, 2, array)


def trigrams(c, array: bool = False) -> Column:
    return ngrams(c, 3, array)


def quadrigrams(c, array: bool = False) -> Column:
    return ngrams(c, 4, array)


def skipgrams(c, k: int, n: int) -> Column:
    """n-grams of an array that may skip up to k elements, in order: each element with every choice of n - 1 of the
    n + k - 1 after it."""
    import itertools

    if k < 1 or n < 1 or n < k:
        raise ValueError("k and n must be 1 at least, and n not less than k")
    a = col(c)
    picks = list(itertools.combinations(range(1, n + k), n - 1))
    table = F.array(*(F.array(*(F.lit(i) for i in (0, *p))) for p in picks))
    at = lambda i: F.filter(table, lambda p: i + F.element_at(p, -1) < F.size(a))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: F.transform(at(i), lambda p: F.transform(p, lambda d: F.get(a, i + d))))
    return F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).otherwise(F.flatten(each))


def lines(c) -> Column:
    return F.split(col(c), r"\r\n|\n\r|\n|\r")


def paragraphs(c) -> Column:
    return F.split(col(c), r"(?:\r\n|\n\r|\n|\r)\s*(?:\r\n|\n\r|\n|\r)")


def words_naive(c) -> Column:
    """Words: capitals before a capitalised word, capitalised or lower-case runs, capital runs, digits; apostrophes of
    contractions stay inside."""
    return findall(c, r"[A-ZÀ-ÖØ-Þ]+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+(?:['’](?:d|ll|m|re|s|t|ve))?|[A-ZÀ-ÖØ-Þ]+(?:['’](?:D|LL|M|RE|S|T|VE))?|\d+|[^\x00-\x{FF}\s\p{Punct}]+")


def words_treebank(c) -> Column:
    """Words as in the Penn treebank: punctuation, quotes and contractions are words of their own."""
    out = F.concat(F.lit(" "), by_rules(col(c), [*TREEBANK_STARTS, *TREEBANK_MARKS, *TREEBANK_BRACKETS]), F.lit(" "))
    out = by_rules(out, [*TREEBANK_ENDS, *TREEBANK_CONTRACTIONS, (r"^\s+|\s+$", "")])
    return F.split(out, r"\s+")
