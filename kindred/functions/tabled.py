"""French algorithms whose published tables are long: the tables are given to them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column

from .text import deburr_text
from .udfs import kernel_column

VOWEL, OTHER = "[aeiouyâàëéêèïîôûùœæ]", "[^aeiouyâàëéêèïîôûùœæ]"
Ending = tuple[int, str, str]  # a stem must measure more than this, for this ending to become that


def measure(stem: str) -> int:
    """2 where a group of vowels is followed by consonants, past leading consonants and before trailing vowels; else 0."""
    core = re.sub(f"{VOWEL}+$", "", re.sub(f"^{OTHER}+", "", stem))
    return 2 if re.search(f"{VOWEL}+{OTHER}+", core) else 0


def carry(word: str, steps: Sequence[Sequence[Ending]]) -> str:
    """The Carry stemmer for French: in each of its three steps the first listed ending that may go does."""
    stem = word.lower()
    for endings in steps:
        for least, end, instead in endings:
            if stem.endswith(end) and measure(stem[: len(stem) - len(end)] + instead) > least:
                stem = stem[: len(stem) - len(end)] + instead
                break
    return stem


@dataclass(frozen=True)
class PhoneticRules:
    """Tables of the French phonetic code: pairs of pattern and replacement, each applied to all matches in order."""

    before: tuple[tuple[str, str], ...] = ()
    exceptions: Mapping[str, str] = field(default_factory=dict)
    then: tuple[tuple[str, str], ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    endings: tuple[tuple[str, str], ...] = ()
    last_endings: tuple[tuple[str, str], ...] = ()

    def __hash__(self) -> int:
        return hash((self.before, tuple(self.exceptions.items()), self.then, self.rules, self.endings, self.last_endings))


@lru_cache(2000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _applied(text: str, rules: Iterable[tuple[str, str]]) -> str:
    for pattern, instead in rules:
        text = _compiled(pattern).sub(instead, text)
    return text


def french_phonetic(word: str, tables: PhoneticRules) -> str:
    """A French phonetic code: folding, exceptions, rules and endings; words that leave too little keep more."""
    word = word.upper().replace("Œ", "OEU").replace("Æ", "E").replace("Ç", "S")
    word = re.sub("[^A-Z]", "", deburr_text(word))
    single = lambda s: re.sub(r"(.)\1", r"\1", s)
    code = single(_applied(word, tables.before))
    if code in tables.exceptions:
        return tables.exceptions[code]
    longer = _applied(code, [*tables.then, *tables.rules, *tables.endings])
    code = single(_applied(longer, tables.last_endings))
    code = "FIOUL" if code == "FUEL" else code
    if code == "O" or len(code) > 1:
        return code
    if re.search("[BCDFGHJKLMNPQRSTVWXYZ]{3}", word):
        return word
    if re.search("[RFMLVSPJDF][AEIOU]", word) and len(word) in (3, 4):
        return word[:-1]
    return longer if len(longer) > 1 else ""


def carry_column(c, steps: Sequence[Sequence[Ending]]) -> Column:
    fixed = tuple(tuple(s) for s in steps)
    return kernel_column(lambda w: carry(w, fixed), "string", c)


def french_phonetic_column(c, tables: PhoneticRules) -> Column:
    return kernel_column(lambda w: french_phonetic(w, tables), "string", c)
