"""Sonnex, a French phonetic code: a table of spellings, of which the first that a word goes on with is taken."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column

from .udfs import kernel_column

# Whole words with a code of their own.
EXCEPTIONS = {
    "cerf": "sEr", "cerfs": "sEr", "de": "de", "est": "E", "es": "E", "huit": "uit", "les": "lE", "mer": "mEr", "mes": "mE", "ressent": "res2", "serf": "sEr", "serfs": "sEr", "sept": "sEt",
    "septième": "sEtiEm", "ses": "sE", "tes": "tE", "eschatologie": "Eskatoloji",
}
VOWEL, CONSONANT = "[aâàäeéèêëiîïoôöuùûüyœ]", "[bcçdfghjklmnpqrstvwxyz]"
# A spelling, its code, and what is put back in front of the rest.
SPELLINGS = [
    ("a$", "a", ""),
    ("aient$", "E", ""),
    ("ain$", "1", ""),
    (f"(?>.*?ain(?=.))(?={VOWEL})", "E", ""),
    ("(?>.*?ain(?=.))", "1", ""),
    ("ais$", "E", ""),
    ("aiss", "Es", ""),
    (f"ais(?={VOWEL})", "Ez", ""),
    ("ais(?=.)", "Es", ""),
    ("ail$", "ai", ""),
    ("aill", "ai", ""),
    ("ai", "E", ""),
    ("amm", "am", ""),
    (f"am(?={VOWEL})", "am", ""),
    ("am(?=.)", "2", ""),
    ("an$", "2", ""),
    ("ann", "an", ""),
    (f"an(?={VOWEL})", "an", ""),
    ("an(?=.)", "2", ""),
    ("assent$", "as", ""),
    ("ass", "as", ""),
    (f"as(?={CONSONANT})", "as", ""),
    ("as(?=.)", "az", ""),
    ("au", "o", ""),
    ("ay$", "E", ""),
    ("ays$", "E", ""),
    ("à", "a", ""),
    ("â", "a", ""),
    ("b$", "", ""),
    ("bb", "b", ""),
    ("c$", "", ""),
    ("c(?=a)", "k", ""),
    ("cc(?=[ou])", "k", ""),
    ("cc.", "ks", ""),
    ("c(?=e)", "s", ""),
    ("c'", "s", ""),
    ("chiro(?=[^u])", "kiro", ""),
    ("ch(?=ao)", "k", ""),
    ("chl", "kl", ""),
    ("ch(?=oe)", "k", ""),
    ("chr", "kr", ""),
    ("ch", "C", ""),
    ("c(?=i)", "s", ""),
    ("ck", "k", ""),
    ("c(?=oeu)", "k", ""),
    ("compt", "k3t", ""),
    ("c(?=o)", "k", ""),
    ("cue(?=i)", "ke", ""),
    ("c(?=u)", "k", ""),
    ("c(?=y)", "s", ""),
    ("c", "k", ""),
    ("ç", "s", ""),
    ("d$", "", ""),
    ("ds$", "", ""),
    ("dd", "d", ""),
    ("e$", "", ""),
    ("ec$", "Ec", ""),
    ("ef$", "Ef", ""),
    ("eaux$", "o", ""),
    ("eann", "an", ""),
    ("ean", "2", ""),
    ("eau", "o", ""),
    ("eff", "Ef", ""),
    ("e(?=gm)", "E", ""),
    ("ein$", "1", ""),
    ("einn", "En", ""),
    (f"ein(?={VOWEL})", "En", ""),
    ("ein(?=.)", "1", ""),
    ("ei", "E", ""),
    ("ell", "El", ""),
    (f"e(?=l{CONSONANT})", "E", ""),
    ("e(?=l.)", "e", ""),
    ("emm", "Em", ""),
    ("em(?=ph)", "2", ""),
    (f"emp(?!{VOWEL}).$", "2", ""),
    ("emp(?=.)", "2p", ""),
    ("enn", "En", ""),
    ("en$", "2", ""),
    (f"en(?={VOWEL})", "en", ""),
    ("en(?=.)", "2", ""),
    ("er$", "E", ""),
    ("ert$", "Er", ""),
    ("err", "Er", ""),
    ("er(?=f)", "Er", ""),
    ("es$", "", ""),
    ("esch", "EC", ""),
    ("essent$", "Es", ""),
    ("es(?=[hn])", "E", ""),
    ("ess", "Es", ""),
    (f"es(?={CONSONANT})", "Es", ""),
    ("es(?=.)", "ez", ""),
    ("ett", "Et", ""),
    ("et$", "E", ""),
    ("et", "et", ""),
    (f"eun(?={VOWEL})", "en", ""),
    ("eun(?=.)", "1", ""),
    ("eux$", "e", ""),
    ("eux(?=i)", "ez", ""),
    ("eu", "e", ""),
    ("ex$", "Eks", ""),
    (f"ey(?={CONSONANT})", "E", ""),
    ("e(?=y.)", "E", ""),
    ("ez$", "E", ""),
    ("è", "E", ""),
    ("ê", "E", ""),
    ("ë(?=l)", "E", ""),
    ("é$", "E", ""),
    ("ét", "Et", ""),
    ("é(?=.)", "E", ""),
    ("ff", "f", ""),
    ("g$", "", ""),
    ("g(?=e)", "j", ""),
    ("gé", "jE", ""),
    ("g(?=i)", "j", ""),
    ("gn", "n", ""),
    ("g(?=y)", "j", ""),
    ("guë", "gu", ""),
    ("gu", "g", ""),
    ("gg", "g", ""),
    ("h", "", ""),
    ("ic$", "ik", ""),
    ("ics$", "ik", ""),
    ("ienn", "iEn", ""),
    ("ien", "i1", ""),
    ("in$", "1", ""),
    ("inn", "in", ""),
    (f"in(?={VOWEL})", "in", ""),
    ("in(?=.)", "1", ""),
    ("issent$", "is", ""),
    ("iss", "is", ""),
    (f"is(?={CONSONANT})", "is", ""),
    ("is(?=.)", "iz", ""),
    ("ix(?=i)", "iz", ""),
    ("ill", "i", ""),
    ("i", "i", ""),
    ("ï", "i", ""),
    ("ll", "l", ""),
    ("mm", "m", ""),
    ("nn", "n", ""),
    ("occ", "ok", ""),
    ("oeu?", "e", ""),
    ("oient$", "Ua", ""),
    ("oin", "U1", ""),
    ("oi", "Ua", ""),
    ("omm", "om", ""),
    (f"om(?={VOWEL})", "om", ""),
    ("om(?=.)", "3", ""),
    ("onn", "on", ""),
    ("on", "3", ""),
    ("ossent$", "os", ""),
    ("oss", "os", ""),
    (f"os(?={CONSONANT})", "os", ""),
    ("os(?=.)", "oz", ""),
    ("o[uùû]", "U", ""),
    ("ô", "o", ""),
    ("p$", "", ""),
    ("ph", "f", ""),
    ("pp", "p", ""),
    ("pays", "pE", "is"),
    ("qu(?=r)", "ku", ""),
    ("qu", "k", ""),
    ("q", "k", ""),
    ("rr", "r", ""),
    ("s$", "", ""),
    ("ss", "s", ""),
    ("st", "st", ""),
    ("sc(?=i)", "s", ""),
    ("t$", "", ""),
    ("t(?=ier)", "t", ""),
    (f"t(?=i{VOWEL})", "s", ""),
    ("t(?=i.)", "t", ""),
    ("tt", "t", ""),
    ("un$", "1", ""),
    ("ussent$", "us", ""),
    ("uss", "us", ""),
    (f"us(?={CONSONANT})", "us", ""),
    ("us(?=.)", "uz", ""),
    ("û", "u", ""),
    ("w", "v", ""),
    ("x$", "", ""),
    ("xc", "ks", ""),
    (f"x(?={VOWEL})", "kz", ""),
    ("x(?=.)", "ks", ""),
    ("y", "i", ""),
    ("zz", "z", ""),
]


def _rules() -> dict[str, list[tuple[re.Pattern, str, str]]]:
    out = defaultdict(list)
    for spelling, code, back in SPELLINGS:
        out["a" if spelling.startswith("(?>") else spelling[0]].append((re.compile(spelling, re.S), code, back))
    return out


RULES = _rules()


def sonnex(word: str) -> str:
    word = re.sub("[’‘`‛']", "", word.lower()).replace("œ", "oe")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    code = ""
    if word.startswith("tien"):
        code, word = "t", word[1:]
    while word:
        for pattern, sound, back in RULES.get(word[0], ()):
            if m := pattern.match(word):
                code, word = code + sound, back + word[m.end() :]
                break
        else:
            code, word = code + word[0], word[1:]
    return code


def sonnex_column(c) -> Column:
    return kernel_column(sonnex, "string", c)
