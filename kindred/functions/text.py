"""Text foundations as Column expressions: folding, squeezing, characters, rule chains, patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to other letters of the Latin alphabet.
FOLDED = {
    "A": "ÀÁÂÃÄÅĀĂĄ", "C": "ÇĆĈĊČ", "D": "ÐĎĐ", "E": "ÈÉÊËĒĔĖĘĚ", "G": "ĜĞĠĢ", "H": "ĤĦ", "I": "ÌÍÎÏĨĪĬĮİ", "J": "Ĵ", "K": "Ķ", "L": "ĹĻĽĿŁ",
    "N": "ÑŃŅŇŊ", "O": "ÒÓÔÕÖØŌŎŐ", "R": "ŔŖŘ", "S": "ŚŜŞŠ", "T": "ŢŤŦ", "U": "ÙÚÛÜŨŪŬŮŰŲ", "W": "Ŵ", "Y": "ÝŶŸ", "Z": "ŹŻŽ",
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ðďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķĸ", "l": "ĺļľŀł",
    "n": "ñńņňŋ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšſ", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
WIDER = {"Æ": "Ae", "æ": "ae", "Þ": "Th", "þ": "th", "ß": "ss", "Œ": "Oe", "œ": "oe", "Ĳ": "IJ", "ĳ": "ij", "ŉ": "'n"}
COMBINING = "[̀-ͯ︠-︯⃐-⃿]"
SPACE = r"[\s   -     　﻿\x0B]"

SOURCE, TARGET = "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items())


def deburr_text(text: str) -> str:
    """deburr() for kernels that run in Python."""
    return text.translate(PY_FOLD)


PY_FOLD = str.maketrans({**dict(zip(SOURCE, TARGET, strict=True)), **WIDER, **{chr(c): "" for a, b in ((0x300, 0x36F), (0xFE20, 0xFE2F), (0x20D0, 0x20FF)) for c in range(a, b + 1)}})


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c, f: Callable[[Column], Column]) -> Column:
    """f of a column that it mentions more than once: what the column stands for is worked out once a row."""
    return F.get(F.transform(F.array(col(c)), f), F.lit(0))


def deburr(c) -> Column:
    """Latin letters with marks, and ligatures, as plain letters; combining marks go."""

    def folded(x: Column) -> Column:
        out = F.translate(x, SOURCE, TARGET)
        for a, b in WIDER.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.regexp_replace(out, COMBINING, "")

    return bound(c, lambda x: F.when(F.octet_length(x) == F.char_length(x), x).otherwise(folded(x)))  # ASCII stays as it is


def clean(c) -> Column:
    """A-Z only: folded, upper-cased, the rest dropped."""
    return F.regexp_replace(F.upper(deburr(c)), "[^A-Z]", "")


def chars(c) -> Column:
    """The characters of a string; an array stays as it is."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(col(c), ""))


def squeeze(c) -> Column:
    """Runs of a character become one."""
    return F.regexp_replace(col(c), r"(?s)(.)\1+", "$1")


def squeeze_array(c) -> Column:
    """Runs of equal elements become one."""
    a = col(c)
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def translation(c, first: str, second: str) -> Column:
    """Characters of first become those of second in the same place."""
    if len(first) != len(second):
        raise ValueError("both alphabets must have the same length")
    return F.translate(col(c), first, second)


def replaced(c, pattern: str, to: str, once: bool = False) -> Column:
    """regexp_replace; once: the first match only."""
    if not once:
        return F.regexp_replace(col(c), pattern, to)
    # put the shortest prefix without a match before what the pattern became; its groups move up by one
    moved = "".join(f"${int(p[1]) + 1}" if len(p) == 2 and p[0] == "$" else p for p in _groups(to))
    return F.regexp_replace(col(c), f"(?s)\\A(.*?)(?:{_shifted(pattern)})", "$1" + moved)


def _groups(to: str) -> list[str]:
    out, i = [], 0
    while i < len(to):
        step = 2 if to[i] == "$" and i + 1 < len(to) and to[i + 1].isdigit() else 1
        out.append(to[i : i + step])
        i += step
    return out


def _shifted(pattern: str) -> str:
    import re

    return re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", pattern)


def by_rules(c, rules: Iterable[tuple]) -> Column:
    """A chain of (pattern, replacement) or (pattern, replacement, True) for the first match only."""
    out = col(c)
    for pattern, to, *once in rules:
        out = replaced(out, pattern, to, bool(once))
    return out


def findall(c, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def escape_regexp(c) -> Column:
    """Characters with a meaning in patterns, and -, with a backslash before."""
    return F.regexp_replace(col(c), r"([|\\{}()\[\]^$+*?.\-])", r"\\$1")


def fuzzy_pattern(c) -> Column:
    """A pattern for strings that hold the characters of this one in order."""
    return F.array_join(F.transform(chars(c), lambda x: F.concat(F.lit("("), escape_regexp(x), F.lit(")"))), ".*?")


# Characters that stand for one another.
SINGLE_QUOTES, DOUBLE_QUOTES, HYPHENS, COMMAS = "’‘`‛'", "«»„‟“”\"", "-‐‒–—―−‑⁃", ",،、"
