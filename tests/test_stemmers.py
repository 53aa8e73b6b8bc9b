"""Stemmer kernels against known stems."""

import pytest

from kindred.functions import stemmers

STEMS = {
    "porter": {"you": "you", "catastrophe": "catastroph", "anathema": "anathema", "mathematics": "mathemat", "adjective": "adject", "building": "build", "spiteful": "spite", "external": "extern", "coffee": "coffe"},
    "lancaster": {"worker": "work", "MARKS": "mark", "living": "liv", "thing": "thing", "ear": "ear", "string": "string", "triplicate": "triply", "classified": "class", "maximum": "maxim", "presumably": "presum", "exceed": "excess", "anguish": "anct", "affluxion": "affluct", "discept": "disceiv"},
    "caumanns": {"": "", "lesen": "les", "buchstabieren": "buchstabier", "singt": "sing", "beliebtester": "belieb", "stören": "stor", "Kuß": "kuss", "Verlies": "verlie", "Müllerinnen": "mullerin", "Matrizen": "matrix", "häufig": "haufig", "abschließenden": "abschliess", "Tische": "tisch", "Hauses": "hau"},
    "eda": dict.fromkeys(["intestin", "intestins", "intestine", "intestinal", "intestinaux", "intestinales"], "intestin"),
    "spanish_unine": {"duo": "duo", "airbus": "airbus", "ofertas": "ofert", "funcionalidad": "funcionalidad", "clones": "clon", "cupón": "cupon", "tríos": "tri", "arroyó": "arroy", "ordeñarás": "ordeñar"},
    "spanish_singular": {"álbumes": "álbum", "almacenes": "almacén", "androides": "androide", "antifaces": "antifaz", "árboles": "árbol", "atlas": "atlas", "autobuses": "autobús", "bases": "base", "bebés": "bebé", "clanes": "clan", "compases": "compás", "convoyes": "convoy", "coxis": "coxis", "déficits": "déficit", "ejes": "eje", "flashes": "flash", "ingleses": "inglés", "luces": "luz", "noes": "no", "padres": "padre", "países": "país", "síes": "sí", "tanques": "tanque", "trenes": "tren"},
}
SCHINKE = {"aetheriis": ("aetheri", "aetherii"), "circumsessum": ("circumsess", "circumsessu"), "receptu": ("recept", "receptu"), "convertunt": ("conuertu", "conuerti"), "ostenditur": ("ostenditur", "ostendi"), "eloquentem": ("eloquent", "eloquente"), "criminationi": ("crimination", "criminationi")}


@pytest.mark.parametrize("kernel", STEMS)
def test_known_stems(kernel):
    for word, stem in STEMS[kernel].items():
        assert getattr(stemmers, kernel)(word) == stem, word


def test_schinke():
    for word, (noun, verb) in SCHINKE.items():
        assert stemmers.schinke(word) == {"noun": noun, "verb": verb}, word


def test_s_stemmer(spark):
    words = {"": "", "one": "one", "is": "is", "queries": "query", "phrases": "phrase", "corpus": "corpus", "stress": "stress", "kings": "king", "serious": "serious"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", stemmers.s_stemmer("w").alias("s")).collect()} == words


def test_uea_lite():
    from kindred.functions.english import uea_lite

    assert uea_lite("ordained") == {"rule": "13.6", "stem": "ordain"} and uea_lite("during") == {"rule": "90", "stem": "during"}
    for word, stem in {"is": "is", "man": "man", "happiness": "happiness", "theses": "thesis", "bases": "base", "killed": "kill", "don't": "do not", "Peter's": "Peter", "USs": "US", "flies": "fly"}.items():
        assert uea_lite(word)["stem"] == stem, word


def test_lovins():
    from kindred.functions.english import lovins

    endings = {"ationally": "B", "ional": "A", "ally": "B", "ing": "N", "ices": "A", "es": "E", "e": "A", "ion": "Q", "ive": "A", "ate": "A", "ic": "A", "ed": "E", "ar": "X", "y": "B", "ides": "L", "ide": "L"}
    known = {"sitting": "sit", "matrix": "matric", "rubbing": "rub", "rubb": "rub", "believe": "belief", "consumption": "consum", "induction": "induc", "absorption": "absorb", "parametric": "parameter", "dissolved": "dissolut", "index": "indic", "persuade": "persuas", "expand": "expans", "respond": "respons"}
    for word, stem in known.items():
        assert lovins(word, endings) == stem, word
