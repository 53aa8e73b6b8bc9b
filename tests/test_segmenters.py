"""Sentences, tweets, syllables and double metaphone against known results."""

from kindred.functions import segmenters as S
from kindred.functions.double_metaphone import double_metaphone

# Names with their primary and secondary codes.
METAPHONE = [
    ("Smith", "SM0", "XMT"),
    ("Schmidt", "XMT", "SMT"),
    ("dictionary", "TKXN", "TKXN"),
    ("knock", "NK", "NK"),
    ("wrangler", "RNKL", "RNKL"),
    ("Williams", "ALMS", "FLMS"),
    ("axis", "AKSS", "AKSS"),
    ("Occasionally", "AKSN", "AKXN"),
    ("beginning", "PJNN", "PKNN"),
    ("changing", "XNJN", "XNKN"),
    ("etiology", "ATLJ", "ATLK"),
    ("judgment", "JTKM", "ATKM"),
    ("john", "JN", "AN"),
    ("Xavier", "SF", "SFR"),
    ("caesar", "SSR", "SSR"),
    ("chianti", "KNT", "KNT"),
    ("michael", "MKL", "MXL"),
    ("arch", "ARX", "ARK"),
    ("orchid", "ARKT", "ARKT"),
    ("wachtler", "AKTL", "FKTL"),
    ("McHugh", "MK", "MK"),
    ("czerny", "SRN", "XRN"),
    ("focaccia", "FKX", "FKX"),
    ("bellocchio", "PLX", "PLX"),
    ("bacchus", "PKS", "PKS"),
    ("accident", "AKST", "AKST"),
    ("succeed", "SKST", "SKST"),
    ("bertucci", "PRTX", "PRTX"),
    ("mac caffrey", "MKFR", "MKFR"),
    ("mac gregor", "MKRK", "MKRK"),
    ("edge", "AJ", "AJ"),
    ("edgar", "ATKR", "ATKR"),
    ("ghislane", "JLN", "JLN"),
    ("hugh", "H", "H"),
    ("bough", "P", "P"),
    ("laugh", "LF", "LF"),
    ("cough", "KF", "KF"),
    ("cagney", "KKN", "KKN"),
    ("tagliaro", "TKLR", "TLR"),
    ("biaggi", "PJ", "PK"),
    ("san jacinto", "SNHS", "SNHS"),
    ("Jankelowicz", "JNKL", "ANKL"),
    ("bajador", "PJTR", "PHTR"),
    ("cabrillo", "KPRL", "KPR"),
    ("gallegos", "KLKS", "KKS"),
    ("dumb", "TM", "TM"),
    ("thumb", "0M", "TM"),
    ("raspberry", "RSPR", "RSPR"),
    ("isle", "AL", "AL"),
    ("snider", "SNTR", "XNTR"),
    ("schneider", "XNTR", "SNTR"),
    ("school", "SKL", "SKL"),
    ("schooner", "SKNR", "SKNR"),
    ("schermerhorn", "XRMR", "SKRM"),
    ("resnais", "RSN", "RSNS"),
    ("artois", "ART", "ARTS"),
    ("thomas", "TMS", "TMS"),
    ("Wasserman", "ASRM", "FSRM"),
    ("Womo", "AM", "FM"),
    ("Arnow", "ARN", "ARNF"),
    ("filipowicz", "FLPT", "FLPF"),
    ("breaux", "PR", "PR"),
    ("zhao", "J", "J"),
    ("thames", "TMS", "TMS"),
]


def test_double_metaphone():
    for name, primary, secondary in METAPHONE:
        assert double_metaphone(name) == [primary, secondary], name


def test_sentences():
    cases = {
        "Hello, my liege. How dost thou fare?": ["Hello, my liege.", "How dost thou fare?"],
        "Hello, my liege.\nHow dost thou fare?": ["Hello, my liege.", "How dost thou fare?"],
        "Hello, my liege... How dost thou fare?": ["Hello, my liege...", "How dost thou fare?"],
        "How about your N.A.T.O. hearings? It was fine!": ["How about your N.A.T.O. hearings?", "It was fine!"],
        "Hello Mr. Salinger. Nice weather, no?": ["Hello Mr. Salinger.", "Nice weather, no?"],
        '"What? No." he said. Well.': ['"What? No." he said.', "Well."],
    }
    for text, want in cases.items():
        assert S.sentences(text) == want
    assert S.sentences("How about Msgr. Casoli? I heard it.", ["Msgr"]) == ["How about Msgr. Casoli?", "I heard it."]


def test_tweets():
    cases = {
        "This is a cooool #dummysmiley: :-) :-P <3 and some arrows < > -> <--": ["This", "is", "a", "cooool", "#dummysmiley", ":", ":-)", ":-P", "<3", "and", "some", "arrows", "<", ">", "->", "<--"],
        "@remy: This is waaaaayyyy too much for you!!!!!!": ["@remy", ":", "This", "is", "waaaaayyyy", "too", "much", "for", "you", "!", "!", "!"],
        "What is this ugly &copy; entity?": ["What", "is", "this", "ugly", "©", "entity", "?"],
        "Oh!, A url: https://google.com": ["Oh", "!", ",", "A", "url", ":", "https://google.com"],
    }
    for tweet, want in cases.items():
        assert S.tweet_words(tweet) == want


def test_sonority_syllables():
    cases = {"history": "his to ry", "History": "His to ry", "justification": "jus ti fi ca tion", "channel": "chan nel", "chapel": "cha pel", "unconstitutional": "un cons ti tu tio nal", "arl": "arl"}
    for word, want in cases.items():
        assert S.sonority_syllables(word) == want.split()


def test_onset_syllables(spark):
    words = "history recipe pro city tree present star ration no log chrome anal lysis cal chapel store".split()
    counts = S.onsets(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    legal = {r.onset for r in S.legal_onsets(counts).collect()}
    assert legal == {"h", "r", "pr", "c", "tr", "st", "n", "l", "chr", "hr", "ch"}
    for word, want in {"history": "hi sto ry", "reciprocity": "re ci pro ci ty", "chronological": "chro no log i cal", "cal": "cal"}.items():
        assert S.onset_syllables(word, frozenset(legal | {"t", "s", "p"})) == want.split()


def test_words_by_language(spark):
    df = spark.createDataFrame([("They'll save, and invest more.", "L'été d'Alain, aujourd'hui.")], "en string, fr string")
    r = df.select(S.words_by_language("en", "en").alias("en"), S.words_by_language("fr", "fr").alias("fr")).first()
    assert r.en == ["They", "'ll", "save", ",", "and", "invest", "more", "."]
    assert r.fr == ["L'", "été", "d'", "Alain", ",", "aujourd'hui", "."]
