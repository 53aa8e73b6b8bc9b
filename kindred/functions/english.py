"""Two more English stemmers: UEA-Lite, and Lovins over a table of endings that is given to it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column

from .udfs import kernel_column

# Fixed values of UEA-Lite: words left alone, contractions, and rules of which the first that fits applies: its number, a pattern, and how
# many letters go (-: none), what stands for the ending instead (with a quote before), or * for the plain endings -s, -ing, -ed and doubles.
UEA_ALONE = {"is", "as", "this", "has", "was", "during", "menses"}
UEA_CONTRACTIONS = [("n't", " not"), ("'ve", " have"), ("'re", " are"), ("'m", " am")]
UEA_RULES = [
    ("90.3", r"^\d+$", "-"),
    ("90.2", r"^\w+-\w+$", "-"),
    ("90.1", "-", "-"),
    ("90", "_", "-"),
    ("91.1", "^[A-Z]+s$", "1"),
    ("91", "^[A-Z]+$", "-"),
    ("92", "^(?:.*[A-Z].*[A-Z]|[A-Z]{1}).*$", "-"),
    ("1", "aceous$", "6"),
    ("2", "ces$", "1"),
    ("3", "cs$", "-"),
    ("4", "sis$", "-"),
    ("5", "tis$", "-"),
    ("6", "ss$", "-"),
    ("7", "eed$", "-"),
    ("7", "eeds$", "1"),
    ("8", "ued$", "1"),
    ("9", "ues$", "1"),
    ("10", "ees$", "1"),
    ("11.4", "iases$", "2"),
    ("11.3", "uses$", "1"),
    ("11.2", "sses$", "2"),
    ("11.1", "eses$", "'esis"),
    ("11", "ses$", "1"),
    ("12.5", "tled$", "1"),
    ("12.4", "pled$", "1"),
    ("12.3", "bled$", "1"),
    ("12.2", "eled$", "2"),
    ("12.1", "lled$", "2"),
    ("12", "led$", "2"),
    ("13.7", "ened$", "2"),
    ("13.6", "ained$", "2"),
    ("13.5", "erned$", "2"),
    ("13.4", "rned$", "2"),
    ("13.3", "nned$", "3"),
    ("13.2", "oned$", "2"),
    ("13.1", "gned$", "2"),
    ("13", "ned$", "1"),
    ("14", "ifted$", "2"),
    ("15", "ected$", "2"),
    ("16", "vided$", "1"),
    ("17", "ved$", "1"),
    ("18", "ced$", "1"),
    ("19.1", "arred$", "3"),
    ("19", "erred$", "3"),
    ("20.5", "urred$", "3"),
    ("20.4", "lored$", "2"),
    ("20.3", "eared$", "2"),
    ("20.2", "tored$", "1"),
    ("20.1", "ered$", "2"),
    ("20", "red$", "1"),
    ("20", "reds$", "2"),
    ("21", "tted$", "3"),
    ("22.6", "noted$", "1"),
    ("22.5", "leted$", "1"),
    ("22.4", "[^vm]ited$", "2"),
    ("22.3", "(?:ch|[vm])i[td]ed$", "1"),
    ("22.2", "uted$", "1"),
    ("22.1", "ated$", "1"),
    ("22", "ted$", "2"),
    ("23", "anges$", "1"),
    ("24", "aining$", "3"),
    ("25", "acting$", "3"),
    ("26", "ttings?$", "'t"),
    ("27", "viding$", "'vide"),
    ("28", "ssed$", "2"),
    ("29", "sed$", "1"),
    ("30", "titudes$", "1"),
    ("31.3", "oed$", "1"),
    ("31.2", "d?oes$", "2"),
    ("31.1", "[oaiu]ked$", "1"),
    ("31", "[aiu]med", "1"),
    ("32", "ulted$", "2"),
    ("33", "uming$", "'ume"),
    ("34", "fulness$", "4"),
    ("35", "ousness$", "4"),
    ("36.1", "r[aeiou]bed$", "1"),
    ("36", "beds?$", "'b"),
    ("37", "ssings?$", "'ss"),
    ("38", "ulting$", "3"),
    ("39", "vings?$", "'v"),
    ("40.7", "eadings?$", "'ead"),
    ("40.6", "oadings?$", "'oad"),
    ("40.5", "edings?$", "'ed"),
    ("40.4", "ddings?$", "'d"),
    ("40.3", "ldings?$", "'ld"),
    ("40.2", "rdings?$", "'rd"),
    ("40.1", "ndings?$", "'nd"),
    ("40", "dings?", "'de"),
    ("41", "llings?$", "'l"),
    ("42.4", "ealings?$", "'eal"),
    ("42.3", "olings?$", "'ol"),
    ("42.2", "ailings?$", "'ail"),
    ("42.1", "elings?$", "'el"),
    ("42", "lings?$", "'le"),
    ("43.2", "nged$", "1"),
    ("43.1", "gged$", "3"),
    ("43", "ged$", "1"),
    ("44.3", "mmings?$", "'m"),
    ("44.2", "rming$", "3"),
    ("44.1", "lming$", "3"),
    ("44", "mings?$", "'me"),
    ("45.2", "ngings?$", "'ng"),
    ("45.1", "ggings?$", "'g"),
    ("45", "gings?$", "'ge"),
    ("46.6", "aning$", "3"),
    ("46.5", "ening$", "3"),
    ("46.4", "gning$", "3"),
    ("46.3", "nning$", "4"),
    ("46.2", "oning$", "3"),
    ("46.1", "rning$", "3"),
    ("46", "ning$", "'ne"),
    ("47", "stings?$", "'st"),
    ("48.4", "etings?$", "'et"),
    ("48.3", "pting$", "3"),
    ("48.2", "ntings?$", "'nt"),
    ("48.1", "cting$", "3"),
    ("48.1", "tings?$", "'ct"),
    ("49", "ssed$", "2"),
    ("50", "les$", "1"),
    ("51", "tes$", "1"),
    ("52", "zed$", "1"),
    ("53", "lled$", "2"),
    ("54.4", "irings?$", "'ire"),
    ("54.3", "urings?$", "'ure"),
    ("54.2", "ncings?$", "'nce"),
    ("54.1", "zing$", "3"),
    ("54", "sings?$", "'se"),
    ("55", "lling$", "3"),
    ("56", "ied$", "'e"),
    ("57", "ating$", "'ate"),
    ("58.2", "dying$", "'die"),
    ("58.2", "^lying$", "'lie"),
    ("58.2", "tying$", "'tie"),
    ("58.1", "thing$", "-"),
    ("58.1", "things$", "1"),
    ("58", r"\w{2}ings?$", "*"),
    ("59", "ies$", "'y"),
    ("60.1", "lves$", "'lf"),
    ("60", "ves$", "1"),
    ("61.3", "aped$", "1"),
    ("61.2", "uded$", "1"),
    ("61.1", "oded$", "1"),
    ("62", r"\w{2}eds?$", "*"),
    ("63.10", "des$", "1"),
    ("63.9", "res$", "1"),
    ("63.8", "pes$", "1"),
    ("63.7", "mes$", "1"),
    ("63.6", "ones$", "1"),
    ("63.5", "izes$", "1"),
    ("63.4", "ures$", "1"),
    ("63.3", "ines$", "1"),
    ("63.2", "ides$", "1"),
    ("63.1", "[kg]es$", "1"),
    ("63", "es$", "2"),
    ("64", "is$", "'e"),
    ("65", "ous$", "-"),
    ("66", "ums$", "-"),
    ("67", "us$", "-"),
    ("68", "s$", "1"),
]
RULES = [(number, re.compile(pattern, re.A), action) for number, pattern, action in UEA_RULES]


def _plain(word: str) -> str:
    word = word.removesuffix("s")
    word = word[:-3] if word.endswith("ing") else word.removesuffix("ed")
    return word[:-1] if word[-1:] == word[-2:-1] else word


def uea_lite(word: str) -> dict[str, str]:
    """The UEA-Lite stemmer: the stem and the number of the rule that gave it."""
    if word in UEA_ALONE:
        return {"rule": "90", "stem": word}
    if "'" in word:
        stem = re.sub("'s?$", "", word, flags=re.I)
        for a, b in UEA_CONTRACTIONS:
            stem = stem.replace(a, b, 1)
        return {"rule": "94", "stem": stem}
    for number, pattern, action in RULES:
        if not pattern.search(word):
            continue
        if action[0] == "'":
            return {"rule": number, "stem": pattern.sub(action[1:], word, count=1)}
        return {"rule": number, "stem": _plain(word) if action == "*" else word if action == "-" else word[: -int(action)]}
    return {"rule": "0", "stem": word}


# Fixed values of the Lovins stemmer: what a stem must be like for an ending to go, by the letters of its table, and how stems are recoded.
LOVINS_CONDITIONS = {
    "A": ".", "B": "^.{3}", "C": "^.{4}", "D": "^.{5}", "E": "[^e]$", "F": "^(?=.{3}).*[^e]$", "G": "^(?=.{3}).*f$", "H": "(t|ll)$", "I": "[^oe]$", "J": "[^ae]$", "K": r"^(?=.{3}).*(l|i|u\we)$", "L": "^(?!.*(u|x|[^o]s)$)",
    "M": "[^acem]$", "N": r"^(?:.{4,}|(?!.*s\w{2}$).{3})$", "O": "[li]$", "P": "[^c]$", "Q": "^(?=.{3}).*[^ln]$", "R": "[nr]$", "S": "(dr|[^t]t)$", "T": "(s|[^o]t)$", "U": "[lmnr]$", "V": "c$", "W": "[^su]$", "X": r"(l|i|u\we)$",
    "Y": "in$", "Z": "[^f]$", "AA": "([dflt]|ph|th|er|or|es)$", "BB": "^(?=.{3})(?!.*(met|ryst))", "CC": "l$",
}
LOVINS_RECODED = [
    ("iev$", "ief"), ("uct$", "uc"), ("umpt$", "um"), ("rpt$", "rb"), ("urs$", "ur"), ("istr$", "ister"), ("metr$", "meter"), ("olv$", "olut"), ("([^aoi])ul$", r"\1l"), ("bex$", "bic"), ("dex$", "dic"), ("pex$", "pic"), ("tex$", "tic"),
    ("ax$", "ac"), ("ex$", "ec"), ("ix$", "ic"), ("lux$", "luc"), ("uad$", "uas"), ("vad$", "vas"), ("cid$", "cis"), ("lid$", "lis"), ("erid$", "eris"), ("pand$", "pans"), ("([^s])end$", r"\1ens"), ("ond$", "ons"), ("lud$", "lus"),
    ("rud$", "rus"), ("([^pt])her$", r"\1hes"), ("mit$", "mis"), ("([^m])ent$", r"\1ens"), ("ert$", "ers"), ("([^n])et$", r"\1es"), ("(yt|yz)$", "ys"),
]


def lovins(word: str, endings: Mapping[str, str]) -> str:
    """The Lovins stemmer. endings: its published table of some 294 endings, each with the letter of its condition.

    The longest ending whose condition the rest fulfils goes; where none does, a last y goes all the same, as the last
    ending tried.
    """
    word = stem = word.lower()
    for size in range(min(len(word) - 2, max(map(len, endings), default=0)), 0, -1):
        left, condition = word[:-size], endings.get(word[-size:])
        if condition and re.search(LOVINS_CONDITIONS[condition], left):
            stem = left
            break
    else:
        stem = word.removesuffix("y") if "y" in endings else word
    if re.search(r"([bdglmnprst])\1$", stem):
        stem = stem[:-1]
    for pattern, instead in LOVINS_RECODED:
        stem = re.sub(pattern, instead, stem)
    return stem


def uea_lite_column(c) -> Column:
    return kernel_column(uea_lite, "struct<rule: string, stem: string>", c)


@lru_cache(4)
def _table(items: tuple[tuple[str, str], ...]) -> dict[str, str]:
    return dict(items)


def lovins_column(c, endings: Mapping[str, str]) -> Column:
    items = tuple(endings.items())
    return kernel_column(lambda w: lovins(w, _table(items)), "string", c)
