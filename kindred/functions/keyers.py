"""Keys that unite spellings, as Column expressions."""

from __future__ import annotations

import itertools
import re
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMMAS, DOUBLE_QUOTES, HYPHENS, SINGLE_QUOTES, SPACE, bound, by_rules, chars, clean, col, deburr
from .tokens import fingerprint_tokens, name_tokens, words_naive
from .udfs import kernel_column

# The order of consonants in omission keys, and titles left out of name signatures.
OMISSION_ORDER = "JKQXZVWYBFMGPDHCLNTSR"
SIGNATURE_TITLES = "Dr|Jr|Md|Mgr|Mr|Mrs|Ms|Mme|Mlle|M|Prof|Phd|St|Sree|Sr"


def fingerprint(c, **options) -> Column:
    """Sorted distinct words, folded and without punctuation, joined by a space."""
    return F.array_join(fingerprint_tokens(c, **options), " ")


def ngrams_fingerprint(c, n: int, **options) -> Column:
    """Sorted distinct n-grams of the text without white space, joined."""
    return F.array_join(fingerprint_tokens(c, ngrams=n, **options), "")


def name_fingerprint(c) -> Column:
    return F.array_join(name_tokens(c), " ")


def name_signature(c) -> Column:
    name = F.regexp_replace(F.lower(deburr(c)), rf"(?i)(?:{SIGNATURE_TITLES})\.?\s+", "")
    return by_rules(name, [("[^a-z]", ""), (r"(\S)[aeiou]+", "$1"), ("[jz]", "g"), ("[qc]", "k")])


def normalize(c, keep_accents: bool = False, keep_case: bool = False) -> Column:
    """Lower case, single spaces, plain quotes, hyphens, commas, ellipses and ligatures, no controls, no marks."""
    out = col(c) if keep_case else F.lower(col(c))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, f"{SPACE}+", " ")), r"[\x00-\x08\x0A-\x1F\x7F]", "")
    marks = [(SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (HYPHENS, "-"), (COMMAS, ",")]
    out = F.translate(out, "".join(m for m, _ in marks), "".join(to * len(m) for m, to in marks))
    for a, b in (("…", "..."), ("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out if keep_accents else deburr(out)


def omission(c) -> Column:
    """Consonants present, rarest first, then vowels in order of appearance."""
    some = lambda n: [F.when(F.contains(n, F.lit(x)), x).otherwise("") for x in OMISSION_ORDER]
    vowels = lambda n: F.array_distinct(chars(F.regexp_replace(n, f"[{OMISSION_ORDER}]", "")))
    return bound(clean(c), lambda n: F.concat(*some(n), F.array_join(vowels(n), "")))


def skeleton(c) -> Column:
    """The first letter, then consonants and vowels each once in order of appearance."""
    vowel = lambda x: F.contains(F.lit("AEIOU"), x)
    key = lambda n, rest: F.concat(F.substring(n, 1, 1), F.array_join(F.filter(rest, lambda x: ~vowel(x)), ""), F.array_join(F.filter(rest, vowel), ""))
    return bound(clean(c), lambda n: bound(F.array_remove(F.array_distinct(chars(n)), F.substring(n, 1, 1)), lambda rest: key(n, rest)))


def name_sets(tokens) -> list[list[str]]:
    """Every choice of two or more distinct tokens, each whole or as its initial, but not all as initials."""
    own = sorted(set(tokens))
    if len(own) < 2:
        return [own]
    out = []
    for mask in range(1, 1 << len(own)):
        some = [t for k, t in enumerate(own) if mask >> k & 1]
        if len(some) > 1:
            forms = ([t, t[0]] if len(t) > 1 else [t] for t in some)
            out += [list(f) for f in itertools.product(*forms) if any(len(t) > 1 for t in f)]
    return out


def name_power_set(c, array: bool = False) -> Column:
    return kernel_column(partial(name_sets), "array<array<string>>", col(c) if array else words_naive(c))
