"""French stemmers and pattern hyphenation: kernels and their columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import lru_cache, partial

from pyspark.sql import Column

from .udfs import kernel_column

VOWELS = frozenset("aeiouyâàëéêèïîôûù")
NOT_VOWEL = "[^aeiouyâàëéêèïîôûù]"

# Endings of the French Porter stemmer in the order in which they are looked for.
STEP_1 = (
    "issements issement atrices atrice ateurs ations logies usions utions ements amment emment ances iqUes ismes ables istes ateur ation logie usion ution ences ement euses ments ance iqUe isme able iste ence ités ives "
    "eaux euse ment eux ité ive ifs aux if"
).split()
STEP_2A = "issaIent issantes iraIent issante issants issions irions issais issait issant issent issiez issons irais irait irent iriez irons iront isses issez îmes îtes irai iras irez isse ies ira ît ie ir is it i".split()
STEP_2B = "eraIent assions erions assent assiez èrent erais erait eriez erons eront aIent antes asses ions erai eras erez âmes âtes ante ants asse ées era iez ais ait ant ée és er ez ât ai as é a".split()
DROPS_E = set("assions assent assiez aIent antes asses âmes âtes ante ants asse ais ait ant ât ai as a".split())
STEP_4 = "ière Ière ion ier Ier e ë".split()
# Fixed values of the complex UniNE stemmer: a word longer than this, with this ending, gets this ending instead, and whether it goes on.
UNINE_RULES = [
    (9, "issement", "ir", False), (8, "issant", "ir", False), (6, "ivement", "if", False), (6, "ement", "e", False), (11, "ficatrice", "fier", False), (10, "ficateur", "fier", False),
    (9, "catrice", "quer", False), (8, "cateur", "quer", False), (8, "atrice", "er", False), (7, "ateur", "er", False), (6, "trice", "teur", True), (5, "ième", "", False), (7, "teuse", "ter", False),
    (6, "teur", "ter", False), (5, "euse", "eu", False), (8, "ère", "er", False), (7, "ive", "if", False), (4, "folle", "fou", False), (4, "molle", "mou", False), (9, "nnelle", "n", False),
    (9, "nnel", "n", False), (4, "ète", "et", True), (8, "ique", "", True), (8, "esse", "e", False), (7, "inage", "in", False), (9, "ualisation", "uel", False), (9, "isation", "", False),
    (9, "isateur", "", False), (8, "ation", "", False), (8, "ition", "", False),
]
UNINE_FOLD = str.maketrans("àáâôèéêùûîç", "aaaoeeeuuic")


def unine_minimal(word: str) -> str:
    """The minimal UniNE stemmer: plurals and final r, e, é, and one of two equal last letters."""
    if len(word) < 6:
        return word
    if word.endswith("x"):
        return word[:-2] + "l" if word.endswith("aux") else word[:-1]
    for end in "sreé":
        word = word.removesuffix(end)
    return word[:-1] if word[-1] == word[-2] else word


def _unine_folded(word: str) -> str:
    if len(word) > 4:
        word = re.sub(r"([A-Za-z_])\1+", r"\1", word.translate(UNINE_FOLD))
    if len(word) > 4:
        word = word.removesuffix("ie")
    if len(word) > 4:
        word = word.removesuffix("r").removesuffix("e").removesuffix("e")
        if re.search(r"([A-Za-z_])\1$", word):
            word = word[:-1]
    return word


def unine_complex(word: str) -> str:
    """The complex UniNE stemmer: plurals, then the first ending that fits, then folding."""
    if len(word) > 5 and word.endswith("x"):
        word = word[:-2] + "l" if word.endswith("aux") and word[-4] != "e" else word[:-1]
    for end in "xs":
        word = word.removesuffix(end) if len(word) > 3 else word
    for longer, end, instead, more in UNINE_RULES:
        if len(word) > longer and word.endswith(end):
            word = word[: -len(end)] + instead
            if not more:
                break
    return _unine_folded(word)


def _region(text: str) -> str:
    """What follows the first consonant after a vowel."""
    m = re.search(f"[{''.join(VOWELS)}]{NOT_VOWEL}", text)
    return text[m.end() :] if m else ""


def _verb_region(word: str) -> str:
    if len(word) < 2:
        return ""
    if word[:3] in ("par", "col", "tap") or (word[0] in VOWELS and word[1] in VOWELS):
        return word[3:]
    first = next((i for i in range(1, len(word)) if word[i] in VOWELS), len(word))
    return word[first + 1 :]


def _marked(word: str) -> str:
    """u and i between vowels, y beside one, and u after q, as capitals: they count as consonants."""
    out = list(word.replace("qu", "qU"))
    for i in range(1, len(out) - 1):
        if (out[i] in "ui" and out[i - 1] in VOWELS and out[i + 1] in VOWELS) or (out[i] == "y" and (out[i - 1] in VOWELS or out[i + 1] in VOWELS)):
            out[i] = out[i].upper()
    return "".join(out)


def _adverb(stem: str, r1: str, r2: str, rv: str) -> str:
    """What is left of an adjective once -ement is gone."""
    if stem.endswith("iv") and "iv" in r2:
        stem = stem[:-2]
        return stem[:-2] if stem.endswith("at") and "at" in r2 else stem
    if stem.endswith("eus"):
        return stem[:-3] if "eus" in r2 else stem[:-1] + "x" if "eus" in r1 else stem
    if stem.endswith(("abl", "iqU")):
        return stem[:-3] if "abl" in r2 or "iqU" in r2 else stem
    if stem.endswith(("ièr", "Ièr")):
        return stem[:-3] + "i" if "ièr" in rv or "Ièr" in rv else stem
    return stem


def _ic(stem: str, r2: str) -> str:
    return stem if not stem.endswith("ic") else stem[:-2] if "ic" in r2 else stem[:-2] + "iqU"


def _derived(end: str, stem: str, r1: str, r2: str) -> str | None:
    """The word without a derivational ending, where its region allows to take it."""
    left, deep = stem[: -len(end)], end in r2
    one = end.removesuffix("s")
    if end == "eaux":
        return stem[:-1]
    if one == "euse":
        return left if deep else left + "eux" if end in r1 else None
    if end == "aux":
        return left + "al" if end in r1 else None
    if one == "issement":
        return left if end in r1 and left[-1:] not in VOWELS else None
    if not deep:
        return None
    if one in ("ance", "iqUe", "isme", "able", "iste", "eux"):
        return left
    if one in ("atrice", "ateur", "ation"):
        return _ic(left, r2)
    if one == "logie":
        return left + "log"
    if one in ("usion", "ution"):
        return left + "u"
    if one == "ence":
        return left + "ent"
    if one == "ité":
        if left.endswith("abil"):
            return left[:-4] if "abil" in r2 else left[:-2] + "l"
        if left.endswith("iv"):
            return left[:-2] if "iv" in r2 else left
        return _ic(left, r2)
    if one in ("if", "ive"):
        return _ic(left[:-2], r2) if left.endswith("at") and "at" in r2 else left
    return None


def _standard_suffix(word: str, r1: str, r2: str, rv: str) -> tuple[str, str, bool]:
    """Step 1: the stem, the verb region, and whether an ending is gone for good; after adverbs in -ment verb endings are looked for too."""
    end = next((e for e in STEP_1 if word.endswith(e)), None)
    if not end:
        return word, rv, False
    left, before = word[: -len(end)], rv.rpartition(end)[0]
    if end in rv:
        match end.removesuffix("s"):
            case "ement":
                return _adverb(left, r1, r2, rv), rv, True
            case "amment":
                return left + "ant", rv[: -len(end)] + "ant", False
            case "emment":
                return left + "ent", rv, False
            case "ment" if before[-1:] in VOWELS and not rv.startswith(end):
                return left, rv[: -len(end)], False
    stem = _derived(end, word, r1, r2)
    return (word, rv, False) if stem is None else (stem, rv, True)


def _verb_suffix(word: str, r2: str, rv: str) -> str | None:
    """Step 2: the word without an ending of verbs in -ir, or else of other verbs; None if it has neither."""
    end = next((e for e in STEP_2A if word.endswith(e)), None)
    if end and end in rv and len(rv) > len(end) and rv.rpartition(end)[0][-1:] not in VOWELS:
        return word[: -len(end)]
    end = next((e for e in STEP_2B if rv.endswith(e)), None)
    if not end or (end == "ions" and end not in r2):
        return None
    return word[: -len(end) - (end in DROPS_E and rv.endswith("e" + end))]


def _residual_suffix(word: str, r2: str, rv: str) -> str:
    """Step 4: a final -s, then what may be left of an ending."""
    if word.endswith("s") and word[-2:-1] and word[-2] not in "aiouès":
        word = word[:-1]
    match next((e for e in STEP_4 if word.endswith(e) and e in rv), None):
        case "ion" if "ion" in r2 and rv[-4:-3] in ("s", "t"):
            return word[:-3]
        case ("ier" | "Ier" | "ière" | "Ière") as end:
            return word[: -len(end)] + "i"
        case "e":
            return word[:-1]
        case "ë" if word[-3:-1] == "gu":
            return word[:-1]
    return word


def french_porter(word: str) -> str:
    """The French Porter (Snowball) stemmer."""
    word = _marked(word.lower())
    r1 = _region(word)
    r2 = _region(r1)
    stem, rv, settled = _standard_suffix(word, r1, r2, _verb_region(word))
    inflected = None if settled else _verb_suffix(stem, r2, rv)
    if settled or inflected is not None:
        stem = stem if settled else inflected
        stem = re.sub("Y$", "i", re.sub("ç$", "c", stem))
    else:
        stem = _residual_suffix(stem, r2, rv)
    stem = re.sub("(enn|onn|ett|ell|eill)$", lambda m: m[0][:-1], stem)
    return re.sub(f"[éè]({NOT_VOWEL}+)$", r"e\1", stem).lower()


class Hyphenator:
    """Liang's hyphenation with patterns as TeX writes them (.hy3ph) and exceptions; no break next to a word's ends."""

    def __init__(self, patterns: Iterable[str], exceptions: Mapping[str, list[str]] | None = None):
        self.points = {re.sub(r"\d", "", p): [int(d or 0) for d in re.split(r"[^\d]", p)] for p in patterns}
        self.longest = max(map(len, self.points), default=0)
        self.exceptions = dict(exceptions or {})

    def __call__(self, word: str) -> list[str]:
        if len(word) <= 4:
            return [word]
        if word.lower() in self.exceptions:
            return list(self.exceptions[word.lower()])
        code = f".{word.lower()}."
        breaks = [0] * (len(code) + 1)
        for i in range(len(code)):
            for j in range(i + 1, min(len(code), i + self.longest) + 1):
                for k, p in enumerate(self.points.get(code[i:j], ())):
                    breaks[i + k] = max(breaks[i + k], p)
        cuts = [i for i in range(2, len(word) - 1) if breaks[i + 1] % 2]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]


@lru_cache(4)
def _hyphenator(patterns: tuple[str, ...], exceptions: tuple[tuple[str, tuple[str, ...]], ...]) -> Hyphenator:
    return Hyphenator(patterns, {k: list(v) for k, v in exceptions})


def hyphenate_column(c, patterns: Iterable[str], exceptions: Mapping[str, list[str]] | None = None) -> Column:
    """patterns: of the language, for example from a TeX distribution's file."""
    key = tuple(patterns), tuple((k, tuple(v)) for k, v in (exceptions or {}).items())
    return kernel_column(lambda w: _hyphenator(*key)(w), "array<string>", c)


def _column(kernel, c) -> Column:
    return kernel_column(kernel, "string", c)


unine_minimal_column = partial(_column, unine_minimal)
unine_complex_column = partial(_column, unine_complex)
french_porter_column = partial(_column, french_porter)
