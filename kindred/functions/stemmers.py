"""Stemmers and inflectors: kernels on one word, and their columns."""

from __future__ import annotations

import re
from functools import partial
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, deburr_text
from .udfs import kernel_column

# Fixed values of the Porter stemmer: endings and what stands for them.
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
# Fixed values of the Lancaster stemmer: ending, what stands for it, and then: "whole" for whole words only, "on" to go on, "stop", or "keep" the word.
LANCASTER = [
    ("ia", "", "whole"),
    ("a", "", "whole"),
    ("bb", "b", "stop"),
    ("ytic", "ys", "stop"),
    ("ic", "", "on"),
    ("nc", "nt", "on"),
    ("dd", "d", "stop"),
    ("ied", "y", "on"),
    ("ceed", "cess", "stop"),
    ("eed", "ee", "stop"),
    ("ed", "", "on"),
    ("hood", "", "on"),
    ("e", "", "on"),
    ("lief", "liev", "stop"),
    ("if", "", "on"),
    ("ing", "", "on"),
    ("iag", "y", "stop"),
    ("ag", "", "on"),
    ("gg", "g", "stop"),
    ("th", "", "whole"),
    ("guish", "ct", "stop"),
    ("ish", "", "on"),
    ("i", "", "whole"),
    ("i", "y", "on"),
    ("ij", "id", "stop"),
    ("fuj", "fus", "stop"),
    ("uj", "ud", "stop"),
    ("oj", "od", "stop"),
    ("hej", "her", "stop"),
    ("verj", "vert", "stop"),
    ("misj", "mit", "stop"),
    ("nj", "nd", "stop"),
    ("j", "s", "stop"),
    ("ifiabl", "", "stop"),
    ("iabl", "y", "stop"),
    ("abl", "", "on"),
    ("ibl", "", "stop"),
    ("bil", "bl", "on"),
    ("cl", "c", "stop"),
    ("iful", "y", "stop"),
    ("ful", "", "on"),
    ("ul", "", "stop"),
    ("ial", "", "on"),
    ("ual", "", "on"),
    ("al", "", "on"),
    ("ll", "l", "stop"),
    ("ium", "", "stop"),
    ("um", "", "whole"),
    ("ism", "", "on"),
    ("mm", "m", "stop"),
    ("sion", "j", "on"),
    ("xion", "ct", "stop"),
    ("ion", "", "on"),
    ("ian", "", "on"),
    ("an", "", "on"),
    ("een", "", "keep"),
    ("en", "", "on"),
    ("nn", "n", "stop"),
    ("ship", "", "on"),
    ("pp", "p", "stop"),
    ("er", "", "on"),
    ("ear", "", "keep"),
    ("ar", "", "stop"),
    ("ior", "", "on"),
    ("or", "", "on"),
    ("ur", "", "on"),
    ("rr", "r", "stop"),
    ("tr", "t", "on"),
    ("ier", "y", "on"),
    ("ies", "y", "on"),
    ("sis", "s", "stop"),
    ("is", "", "on"),
    ("ness", "", "on"),
    ("ss", "", "keep"),
    ("ous", "", "on"),
    ("us", "", "whole"),
    ("s", "", "on"),
    ("s", "", "stop"),
    ("plicat", "ply", "stop"),
    ("at", "", "on"),
    ("ment", "", "on"),
    ("ent", "", "on"),
    ("ant", "", "on"),
    ("ript", "rib", "stop"),
    ("orpt", "orb", "stop"),
    ("duct", "duc", "stop"),
    ("sumpt", "sum", "stop"),
    ("cept", "ceiv", "stop"),
    ("olut", "olv", "stop"),
    ("sist", "", "keep"),
    ("ist", "", "on"),
    ("tt", "t", "stop"),
    ("iqu", "", "stop"),
    ("ogu", "og", "stop"),
    ("siv", "j", "on"),
    ("eiv", "", "keep"),
    ("iv", "", "on"),
    ("bly", "bl", "on"),
    ("ily", "y", "on"),
    ("ply", "", "keep"),
    ("ly", "", "on"),
    ("ogy", "og", "stop"),
    ("phy", "ph", "stop"),
    ("omy", "om", "stop"),
    ("opy", "op", "stop"),
    ("ity", "", "on"),
    ("ety", "", "on"),
    ("lty", "l", "stop"),
    ("istry", "", "stop"),
    ("ary", "", "on"),
    ("ory", "", "on"),
    ("ify", "", "stop"),
    ("ncy", "nt", "on"),
    ("acy", "", "on"),
    ("iz", "", "on"),
    ("yz", "ys", "stop"),
]
# Fixed values of the Schinke stemmer: words whose -que stays, noun endings, verb endings and what stands for them.
SCHINKE_QUE = set(
    "atque quoque neque itaque absque apsque abusque adaeque adusque denique deque susque oblique peraeque plenisque quandoque quisque quaeque cuiusque cuique quemque quamque quaque quique quorumque quarumque quibusque "
    "quosque quasque quotusquisque quousque ubique undique usque uterque utique utroque utribique torque coque concoque contorque detorque decoque excoque extorque obtorque optorque retorque recoque attorque incoque "
    "intorque praetorque".split()
)
SCHINKE_NOUN = "ibus ius ae am as em es ia is nt os ud um us a e i o u".split()
SCHINKE_VERB = [
    ("iuntur", "i"), ("erunt", "i"), ("untur", "i"), ("iunt", "i"), ("unt", "i"), ("beris", "bi"), ("bor", "bi"), ("bo", "bi"), ("ero", "eri"), ("mini", ""), ("ntur", ""), ("stis", ""), ("mur", ""),
    ("mus", ""), ("ris", ""), ("sti", ""), ("tis", ""), ("tur", ""), ("ns", ""), ("nt", ""), ("ri", ""), ("m", ""), ("r", ""), ("s", ""), ("t", ""),
]
# Fixed values of the EDA stemmer: endings in the one order in which they are tried.
EDA = "s e x ant al au tion sion er iv if abl ibl ment tele tel tos ik ton tos ent en tik toid o i s dien u e era ank enk teur trice i".split()
# Fixed values of German stemming: letter groups that count as one letter.
CAUMANNS_GROUPS = [("sch", "$"), ("ch", "§"), ("ei", "%"), ("ie", "&"), ("ig", "#"), ("st", "!")]
# Fixed values of Spanish nouns: words that are their own plural, irregular plurals, and rules of which the first that fits applies.
SPANISH_SAME = set("lunes martes miércoles jueves viernes paraguas tijeras gafas vacaciones víveres cumpleaños virus atlas sms hummus".split())
SPANISH_IRREGULAR = {
    "bases": "base", "caracteres": "carácter", "champús": "champú", "currículos": "curriculum", "especímenes": "espécimen", "jerséis": "jersey", "memorandos": "memorándum", "menús": "menú",
    "noes": "no", "países": "país", "referendos": "referéndum", "regímenes": "régimen", "sándwiches": "sándwich", "sis": "si", "taxis": "taxi", "ultimatos": "ultimátum",
}
SPANISH_RULES = [
    ("^([bcdfghjklmnñpqrstvwxyz]*)([aeiou])([ns])es$", r"\1\2\3"), ("([aeiou])([ns])es$", None), ("shes$", "sh"), ("oides$", "oide"), ("(sis|tis|xis)$", r"\1"), ("(é)s$", r"\1"), ("(ces)$", "z"), ("([^e])s$", r"\1"),
    ("([bcdfghjklmnñprstvwxyz]{2,}e)s$", r"\1"), ("([ghñptv]e)s$", r"\1"), ("jes$", "je"), ("ques$", "que"), ("es$", ""),
]
SPANISH_MARKED = str.maketrans("AEIOUaeiou", "ÁÉÍÓÚáéíóú")
SPANISH_PLAIN = str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii")

VOWELS, NOT_VOWEL = "[aeiouy]", "[^aeiou]"
MEASURED = re.compile(f"^{NOT_VOWEL}*{VOWELS}+{NOT_VOWEL}+")  # one vowel-consonant group at least
MEASURED_TWICE = re.compile(f"^{NOT_VOWEL}*{VOWELS}+{NOT_VOWEL}+{VOWELS}+{NOT_VOWEL}+")
MEASURED_ONCE = re.compile(f"^{NOT_VOWEL}*{VOWELS}+{NOT_VOWEL}+{VOWELS}*$")
SHORT_END = re.compile(f"^{NOT_VOWEL}+{VOWELS}[^aeiouwxy]$")


def ending(word: str, endings) -> str | None:
    """The longest of some endings, if a letter at least stands before it."""
    return max((e for e in endings if word.endswith(e) and len(word) > len(e)), key=len, default=None)


def porter(word: str) -> str:
    """The Porter stemmer for English."""
    word = word.lower()
    if len(word) < 3:
        return word
    if word[0] == "y":
        word = "Y" + word[1:]
    if ending(word, ["sses", "ies"]):
        word = word[:-2]
    elif re.search("..*[^s]s$", word):
        word = word[:-1]
    if ending(word, ["eed"]):
        word = word[:-1] if MEASURED.search(word[:-3]) else word
    elif (e := ending(word, ["ed", "ing"])) and re.search(f"^{NOT_VOWEL}*{VOWELS}", word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")) or (SHORT_END.search(word) and not re.search(r"([^aeiouylsz])\1$", word)):
            word += "e"
        elif re.search(r"([^aeiouylsz])\1$", word):
            word = word[:-1]
    if word.endswith("y") and re.search(VOWELS, word[:-1]):
        word = word[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        if (e := ending(word, table)) and MEASURED.search(word[: -len(e)]):
            word = word[: -len(e)] + table[e]
    if e := ending(word, PORTER_4):
        word = word[: -len(e)] if MEASURED_TWICE.search(word[: -len(e)]) else word
    elif ending(word, ["sion", "tion"]) and len(word) > 4 and MEASURED_TWICE.search(word[:-3]):
        word = word[:-3]
    if word.endswith("e") and len(word) > 1:
        stem = word[:-1]
        if MEASURED_TWICE.search(stem) or (MEASURED_ONCE.search(stem) and not SHORT_END.search(stem)):
            word = stem
    if word.endswith("ll") and MEASURED_TWICE.search(word):
        word = word[:-1]
    return word.lower()


def _lancaster_rules() -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list] = {}
    for rule in LANCASTER:
        out.setdefault(rule[0][-1], []).append(rule)
    return out


LANCASTER_RULES = _lancaster_rules()


def lancaster(word: str) -> str:
    """The Lancaster (Paice-Husk) stemmer. After a rule that does not ask to go on, the next of the same letter is tried."""
    stem, whole, more = word.lower(), True, True
    while more:
        more = False
        for end, instead, then in LANCASTER_RULES.get(stem[-1:], ()):
            if (then == "whole" and not whole) or not stem.endswith(end):
                continue
            if then == "keep":
                return stem
            left = stem[: len(stem) - len(end)] + instead
            if not (len(left) > 1 if left[:1] and left[0] in "aeiouy" else len(left) > 2 and re.search(VOWELS, left)):
                continue
            stem = left
            if then == "on":
                whole, more = False, True
                break
    return stem


def s_stemmer(c) -> Column:
    """Plural endings of English: -ies, -es, -s with their exceptions."""
    w = col(c)
    keep = (F.char_length(w) < 3) | ~w.endswith("s") | w.rlike("[us]s$")
    ies = w.rlike("(^|[^ae])ies$") & (F.char_length(w) > 3)
    return F.when(keep, w).when(ies, F.regexp_replace(w, "ies$", "y")).when(w.rlike("[iaoe]es$"), w).otherwise(F.regexp_replace(w, "s$", ""))


def schinke(word: str) -> dict[str, str]:
    """The Schinke stemmer for Latin: a stem for the word as a noun and one as a verb."""
    word = re.sub("[^a-z]", "", word.lower()).translate(str.maketrans("jv", "iu"))
    if word in SCHINKE_QUE:
        return {"noun": word, "verb": word}
    stem = word.removesuffix("que")
    noun = next((stem[: -len(e)] for e in SCHINKE_NOUN if stem.endswith(e)), stem)
    verb = stem
    for end, instead in SCHINKE_VERB:
        if stem.endswith(end):
            left = stem[: -len(end)]
            verb = left + instead if not instead or len(left) > 1 else stem
            break
    return {"noun": noun if len(noun) > 1 else stem, "verb": verb if len(verb) > 1 else stem}


def _shortened(stem: str) -> str:
    return stem.removesuffix("e").removesuffix("s")


def eda(word: str) -> str:
    """The EDA stemmer for French, for medical words."""
    stem = "".join(k for k, _ in groupby(deburr_text(word.lower())))
    if len(stem) <= 5:
        return _shortened(stem)
    stem = re.sub("cqu|qu|ck?", "k", stem).replace("y", "i")
    for end in EDA:
        if stem.endswith(end):
            stem = stem[: -len(end)]
            if len(stem) <= 5:
                return _shortened(stem)
    return stem


def caumanns(word: str) -> str:
    """The Caumanns stemmer for German."""
    if not word:
        return ""
    initial = word[0] == word.upper()  # true of single capitals only
    word = word.lower().translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}))
    stem = word[0] + "".join("*" if y == x else y for x, y in zip(word, word[1:], strict=False))
    for group, sign in CAUMANNS_GROUPS:
        stem = stem.replace(group, sign)
    while len(stem) > 3:
        if (len(stem) > 4 and stem.endswith(("em", "er"))) or (len(stem) > 5 and stem.endswith("nd")):
            stem = stem[:-2]
        elif stem[-1] in "esn" or (not initial and stem[-1] in "t!"):
            stem = stem[:-1]
        else:
            break
    if len(stem) > 5 and stem.endswith("erin*"):
        stem = stem[:-1]
    if stem.endswith("z"):
        stem = stem[:-1] + "x"
    for group, sign in CAUMANNS_GROUPS:
        stem = stem.replace(sign, group)
    out = stem[:1]
    for c in stem[1:]:
        out += out[-1] if c == "*" else c
    return out.replace("gege", "ge", 1) if len(out) < 4 else out


def spanish_unine(word: str) -> str:
    """The light UniNE stemmer for Spanish: plural and gender endings."""
    if len(word) < 5:
        return word
    word = word.translate(SPANISH_PLAIN)
    if word[-1] in "oae":
        return word[:-1]
    if word.endswith("eses"):
        return word[:-2]
    if word.endswith("ces"):
        return word[:-3] + "z"
    return word[:-2] if word.endswith(("os", "as", "es")) else word


def spanish_singular(noun: str) -> str:
    """The singular of a Spanish noun; an irregular one gets the case of the plural's letters."""
    if noun.lower() in SPANISH_SAME:
        return noun
    if noun in SPANISH_IRREGULAR:
        return "".join(c.lower() if p == p.lower() else c.upper() for p, c in zip(noun, SPANISH_IRREGULAR[noun], strict=False))
    for pattern, instead in SPANISH_RULES:
        if re.search(pattern, noun, re.I):
            marked = lambda m: m[1].translate(SPANISH_MARKED) + m[2]
            return re.sub(pattern, instead if instead is not None else marked, noun, count=1, flags=re.I)
    return noun


def _column(kernel, kind: str, c) -> Column:
    return kernel_column(kernel, kind, c)


porter_column = partial(_column, porter, "string")
lancaster_column = partial(_column, lancaster, "string")
schinke_column = partial(_column, schinke, "struct<noun: string, verb: string>")
eda_column = partial(_column, eda, "string")
caumanns_column = partial(_column, caumanns, "string")
spanish_unine_column = partial(_column, spanish_unine, "string")
spanish_singular_column = partial(_column, spanish_singular, "string")
