"""Phonetic codes that are chains of rules, as Column expressions. Names are folded and cleaned first; '' stays ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, by_rules, clean, col, deburr, replaced, squeeze

# The rules and alphabets of each code, in the order in which they apply. A third member: first match only.
CAVERPHONE_HEAD = [("e$", ""), ("^(cou|rou|tou|enou|trou)gh", "$12f"), ("^gn", "2n")]
CAVERPHONE_ORIGINAL = [("^mb", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia")]
CAVERPHONE_REVISITED = [("mb$", "mb"), ("cq", "2q"), ("c([iey])", "s$1"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("ti([oa])", "si$1")]
CAVERPHONE_MIDDLE = [("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3")]
CAVERPHONE_TAIL = [
    ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"),
    ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
]
METAPHONE = [
    (r"([bcdfhjklmnpqrstvwxyz])\1+", "$1"), ("^ae", "E"), ("^[gkp]n", "N"), ("^wr", "R"), ("^x", "S"), ("^wh", "W"), ("mb$", "M"), ("(?!^)sch", "SK"), ("th", "0"), ("t?ch|sh", "X"),
    ("c(?=ia)", "X"), ("[st](?=i[ao])", "X"), ("s?c(?=[iey])", "S"), ("[cq]", "K"), ("dg(?=[iey])", "J"), ("d", "T"), ("g(?=h[^aeiou])", ""), ("gn(ed)?", "N"), ("([^g]|^)g(?=[iey])", "$1J"),
    ("g+", "K"), ("ph", "F"), (r"([aeiou])h(?=\b|[^aeiou])", "$1"), ("[wy](?![aeiou])", ""), ("z", "S"), ("v", "F"), ("(?!^)[aeiou]+", ""),
]
NYSIIS_FIRST = [("JR$", ""), ("SR$", ""), ("^MAC", "MCC"), ("^KN", "NN"), ("^K", "C"), ("^(PH|PF)", "FF"), ("^SCH", "SSS"), ("(EE|IE)$", "Y"), ("(DT|RT|R+D|N+T|N+D)$", "D")]
NYSIIS_SECOND = [
    ("EV", "AF"), ("[EIOU]", "A"), ("Q", "G"), ("Z", "S"), ("(M|KN)", "N"), ("K", "C"), ("SCH", "SSS"), ("PH", "FF"), ("([^A])H", "$1"), ("(.)H[^A]", "$1"), ("AW", "A"), ("S$", ""), ("AY$", "Y"), ("A$", ""),
]
NYSIIS_REFINED_FIRST = [("JR$", ""), ("SR$", ""), ("(S|Z)$", ""), ("MAC", "MC"), ("PH", "F"), ("IX$", "IC"), ("EX$", "EC"), ("(YE|EE|IE)", "Y"), ("(DT|RT|R+D|N+T|N+D)$", "D"), ("(.+)EV", "$1EF")]
NYSIIS_REFINED_SECOND = [
    ("([AEIOU]+)W", "$1"), ("[EIOU]", "A"), ("AA+", "A"), ("GHT", "GT"), ("DG", "G"), ("PH", "F"), ("(.+)HA", "$1A"), ("A+H", "A"), ("KN", "N"), ("K", "C"), ("(.+)M", "$1N"), ("(.+)Q", "$1G"),
    ("(SH|SCH)", "S"), ("YW", "Y"), ("(.+)Y(.+)", "$1A$2"), ("WR", "R"), ("(.+)Z", "$1S"), ("AY$", "Y"), ("A+$", ""), (r"^\w", ""),
]
SOUNDEX_LETTERS = "AEIOUYWHBPFVCKSGJQXZDTLMNR"
REFINED_CODES = "000000DD112233344555667889"
FRENCH_LETTERS, FRENCH_CODES = "AEIOUYWHBPCKQDTLMNRGJSXZFV", "000000DD112223345567788899"
LEIN_LETTERS, LEIN_CODES = "DTMNLRBFPVCJKGQSXZ", "112233444455555555"
FONEM = {
    "V-1": ("E?AU", "O"), "V-2": ("(?:E?AU|O)LT$", "O"), "V-3": ("E?AUT$", "O"), "V-4": ("E?AUX$", "O"), "V-5": ("(?:E?AU|O)LX$", "O"), "V-6": ("E?AUL?D$", "O"), "V-7": ("([^G])AY$", "$1E"),
    "V-8": ("EUX$", "EU"), "V-9": ("EY(?=$|[^AEIOUY])", "E"), "V-10": ("(^|[^AEIOUY])Y|Y([^AEIOUY]|$)", "$1I$2"), "V-11": ("([AEIOUY])I(?=[AEIOUY])", "$1Y"), "V-12": ("([AEIOUY])ILL", "$1Y"),
    "V-13": ("OU(?=I(?!LL)|[AEOU])", "W"), "V-14": (r"([AEIOUY])\1", "$1"), "V-15": ("[AE]M(?=[^AEIOUYN](?!$))", "EN"), "V-16": ("OM(?=[^AEIOUYN])", "ON"), "V-17": ("AN(?=[^AEIOUY])", "EN"),
    "V-18": ("(?:AIM|AIN|EIN)(?=[^AEIOUY]|$)", "IN"), "V-19": ("(?:BORNE?|BOURNE?|BURNE)$", "BURN"), "V-20": ("(?:^IM|IM(?=[^AEIOUY]))(?=[^AEIOUYN])", "IN"),
    "C-1": ("BV", "V"), "C-2": ("([AEIOUY])C(?=[EIY])", "$1SS"), "C-3": ("([^CX])C(?=[EIY])", "$1S"), "C-4": ("^C(?=[EIY])", "S"), "C-5": ("^C(?=[AOU])", "K"), "C-6": ("([AEIOUY])C$", "$1K"),
    "C-7": ("C(?=[^AEIOUYCH])", "K"), "C-8": ("CC(?=[AOU])", "K"), "C-9": ("CC(?=[EIY])", "X"), "C-10": ("G(?=[EIY])", "J"), "C-11": ("GA(?=I?[MN])", "G§"), "C-12": ("(?:GEO|GEAU)", "JO"),
    "C-13": ("GNI(?=[AEIOUY])", "GN"), "C-14": ("(^|[^CPS])H", "$1"), "C-15": ("JEA", "JA"), "C-16": ("^MAC(?=[^AEIOUY])", "M§"), "C-17": ("^MC", "M§"), "C-18": ("PH", "F"), "C-19": ("QU", "K"),
    "C-20": ("^SC(?=[EIY])", "S"), "C-21": ("(.)SC(?=[EIY])", "$1SS"), "C-22": ("(.)SC(?=[AOU])", "$1SK"), "C-23": ("SH", "CH"), "C-24": ("TIA$", "SSIA"), "C-25": ("([AIOUY])W", "$1"), "C-26": ("X[CSZ]", "X"),
    "C-27": ("(?:Z(?=[AEIOUY])|([^AEIOUY])Z(?=[^AEIOUY]))", "$1S"),
    "C-28": (r"(?:([^AEIOUYCLS])\1|(C)C(?![AEIOUY])|([^AEIOUY]S)S|(.S)S(?![AEIOUY])|([^I]L)L)", "$1$2$3$4$5"), "C-28-bis": ("ILE$", "ILLE"),
    "C-29": ("(?:(ILS)|([CS]H)|([MN]P)|(R[CFKLNSX])|([^AEIOUY])[^AEIOUY])$", "$1$2$3$4$5"), "C-30": ("^(?:SINT?|SAINT?|SEIN|SEIM|CINQ?)", "ST-"), "C-31": ("^SAINTE", "STE-"), "C-32": ("^ST(?!E)", "ST-"), "C-33": ("^STE", "STE-"),
}
FONEM_ORDER = (
    "V-14 C-28 C-28-bis C-12 C-9 C-10 C-16 C-17 C-20 C-2 C-3 C-7 V-2 V-3 V-4 V-5 V-6 V-1 C-14 C-11 C-33 C-32 C-31 C-30 V-15 V-17 V-18 V-7 V-8 V-9 V-10 V-11 V-12 V-13 V-16 V-19 V-20 "
    "C-1 C-4 C-5 C-6 C-8 C-13 C-15 C-18 C-19 C-21 C-22 C-23 C-24 C-25 C-26 C-27 C-29 V-14 C-28 C-28-bis"
).split()
SOUNDEX2_GROUPS = [("GU([IE])", "K$1"), ("G([AO])", "K$1"), ("GU", "K"), ("C([AOU])", "K$1"), ("(?:Q|CC|CK)", "K")]
SOUNDEX2_PREFIXES = [("^MAC", "MCC"), ("^SCH", "SSS"), ("^ASA", "AZA"), ("^KN", "NN"), ("^PH", "FF"), ("^PF", "FF")]
FRENCH_PHONEX_ACCENTS = ("ÀÂÄÃÉÈÊËÌÎÏÒÔÖÕÙÛÜÑ", "AAAAYYYYIIIOOOOUUUN")
FRENCH_PHONEX = [
    ("Y", "I"), ("([^PCS])H", "$1"), ("PH", "F"), ("G(AI?[NM])", "K$1"), ("[AE]I[NM]([AEIOU])", "YN$1"), ("EAU", "O", True), ("OUA", "2", True), ("[EA]I[NM]", "4"), ("[EA]I", "Y"), ("E([RTZ])", "Y$1"),
    ("ESS", "YS"), ("[AOE]N([^AEIOU1234])", "1$1"), ("[AE]M([^AEIOU1234])", "1$1"), ("IN([^AEIOU1234])", "4$1"), ("([AEIOUY1234])S([AEIOUY1234])", "$1Z$2"), ("(?:OE|EU)", "E"), ("AU", "O"),
    ("O[IY]", "2"), ("OU", "3"), ("(?:SCH|CH|SH)", "5"), ("S[CS]", "S"), ("C([EI])", "S$1", True), ("(?:GU|QU|Q|C)", "K"), ("G([AOY])", "K$1"),
]
PHONEM = [("(?:SC|SZ|CZ|TZ|TS)", "C"), ("KS", "X"), ("(?:PF|PH)", "V"), ("QU", "KW"), ("UE", "Y"), ("AE", "E"), ("OE", "Ö"), ("E[IY]", "AY"), ("EU", "OY"), ("AU", "A§"), ("OU", "§")]
PHONEM_LETTERS = ("ZKGQÇÑßFWPTÁÀÂÃÅÄÆÉÈÊËIJÌÍÎÏÜÝ§ÚÙÛÔÒÓÕØ", "CCCCCNSVVBDAAAAAEEEEEEYYYYYYYYUUUUOOOOÖ")


def from_second(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.char_length(c))


def padded(c: Column, size: int, fill: str = "0") -> Column:
    return F.rpad(c, size, fill)


def nonempty(source: Column, code: Column) -> Column:
    """'' for a name that cleaning leaves empty."""
    return F.when(source == "", "").otherwise(code)


def lower_clean(c) -> Column:
    return F.regexp_replace(F.lower(deburr(c)), "[^a-z]", "")


def caverphone(c, revisited: bool = False) -> Column:
    rules = [*CAVERPHONE_HEAD, *(CAVERPHONE_REVISITED if revisited else CAVERPHONE_ORIGINAL), *CAVERPHONE_MIDDLE, ("j" if revisited else "i", "y"), *CAVERPHONE_TAIL]
    return padded(by_rules(lower_clean(c), rules), 10, "1")


def metaphone(c) -> Column:
    return F.upper(by_rules(lower_clean(c), METAPHONE))


def nysiis(c, refined: bool = False) -> Column:
    name = by_rules(clean(c), NYSIIS_REFINED_FIRST if refined else NYSIIS_FIRST)
    rest = lambda n: by_rules(n, NYSIIS_REFINED_SECOND) if refined else by_rules(from_second(n), NYSIIS_SECOND)
    return bound(name, lambda n: F.concat(F.substring(n, 1, 1), squeeze(rest(n))))


def _soundex(name: Column, letters: str, codes: str) -> Column:
    def tail(digits: Column) -> Column:
        rest = F.replace(from_second(digits), F.lit("D"), F.lit(""))
        return bound(rest, lambda t: F.when(F.substring(t, 1, 1) == F.substring(digits, 1, 1), from_second(t)).otherwise(t))

    code = lambda n: F.replace(squeeze(bound(F.translate(n, letters, codes), tail)), F.lit("0"), F.lit(""))
    return bound(name, lambda n: padded(F.concat(F.substring(n, 1, 1), code(n)), 4))


def soundex(c) -> Column:
    """The built-in code of the cleaned name; '0000' for an empty one."""
    return bound(clean(c), lambda n: F.when(n == "", "0000").otherwise(F.soundex(n)))


def soundex_refined(c) -> Column:
    code = lambda n: squeeze(F.replace(F.translate(n, SOUNDEX_LETTERS, REFINED_CODES), F.lit("D"), F.lit("")))
    return bound(clean(c), lambda n: F.concat(F.substring(n, 1, 1), code(n)))


def onca(c) -> Column:
    return soundex(nysiis(c))


def mra(c) -> Column:
    codex = bound(clean(c), lambda n: squeeze(F.concat(F.substring(n, 1, 1), F.regexp_replace(from_second(n), "[AEIOU]", ""))))
    tail = lambda x: F.least(F.lit(3), F.char_length(x) - 3)
    return bound(codex, lambda x: F.concat(F.substring(x, 1, 3), F.when(tail(x) > 0, F.right(x, tail(x))).otherwise("")))


def spaced(c) -> Column:
    return F.regexp_replace(F.upper(deburr(c)), r"[^A-Z\s]", "")


def lein(c) -> Column:
    code = lambda n: F.substring(squeeze(F.regexp_replace(from_second(n), "[AEIOUYWH]", "")), 1, 4)
    return bound(spaced(c), lambda n: nonempty(n, padded(F.concat(F.substring(n, 1, 1), F.translate(code(n), LEIN_LETTERS, LEIN_CODES)), 4)))


def statcan(c) -> Column:
    code = lambda n: F.regexp_replace(squeeze(F.regexp_replace(from_second(n), "[AEIOUY]", "")), r"\s", "")
    return bound(spaced(c), lambda n: F.substring(F.concat(F.substring(n, 1, 1), code(n)), 1, 4))


def fonem(c) -> Column:
    """French names. Only the first character that is no letter is dropped."""
    code = replaced(F.upper(deburr(c)), "[^A-Z]", "", once=True)
    code = by_rules(code, [FONEM[k] for k in FONEM_ORDER])
    return F.replace(F.replace(code, F.lit("G§"), F.lit("GA")), F.lit("M§"), F.lit("MAC"))


def french_soundex(c) -> Column:
    name = F.replace(F.replace(F.upper(col(c)), F.lit("Ç"), F.lit("S")), F.lit("Œ"), F.lit("E"))
    return _soundex(F.regexp_replace(deburr(name), "[^A-Z]", ""), FRENCH_LETTERS, FRENCH_CODES)


def soundex2(c) -> Column:
    """French names. Only the first character that is no letter is dropped."""
    code = replaced(F.upper(deburr(F.trim(col(c)))), "[^A-Z]", "", once=True)
    code = bound(by_rules(code, SOUNDEX2_GROUPS), lambda x: F.concat(F.substring(x, 1, 1), F.regexp_replace(from_second(x), "[AEIOU]", "A")))
    code = by_rules(code, [*SOUNDEX2_PREFIXES, ("([^CS])H", "$1"), ("([^A])Y", "$1"), ("[ADTS]$", "")])
    code = bound(code, lambda x: F.concat(F.substring(x, 1, 1), F.replace(from_second(x), F.lit("A"), F.lit(""))))
    return F.substring(squeeze(code), 1, 4)


def french_phonex(c) -> Column:
    code = F.regexp_replace(F.translate(F.upper(col(c)), *FRENCH_PHONEX_ACCENTS), "[^A-Z]", "")
    code = F.translate(by_rules(code, FRENCH_PHONEX), "ADPJBVM", "OTTGFFN")
    return F.regexp_replace(squeeze(code), "[TX]$", "")


def phonem(c) -> Column:
    """German names."""
    code = F.translate(by_rules(F.upper(col(c)), PHONEM), *PHONEM_LETTERS)
    return F.regexp_replace(squeeze(code), "[^ABCDLMNORSUVWXYÖ]", "")
