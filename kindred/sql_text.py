"""DuckDB SQL for chains of rules, built from the rules themselves; words are lower-case a-z (column word, upper: u)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from kindred.functions import keyers, phonetics, stemmers, tokens

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chain(x: str, rules: Iterable[tuple]) -> str:
    """Nested replacements of (pattern, replacement) or (pattern, replacement, True) for the first match only."""
    for pattern, to, *once in rules:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(re.sub(r'\$(\d)', r'\\\1', to))}" + (")" if once else ", 'g')")
    return x


def squeezed(x: str, letters: str = LETTERS) -> str:
    return chain(x, [(f"{c}{{2,}}", c) for c in letters])


def soundex(x: str) -> str:
    """Of upper-case letters: digits with vowels as 0, H and W out, runs once, zeros out; '0000' for none."""
    digits = f"translate({x}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
    runs = squeezed(f"(substr({digits}, 1, 1) || replace(substr({digits}, 2), '7', ''))", "01234567")
    return f"CASE WHEN {x} = '' THEN '0000' ELSE rpad(substr({x}, 1, 1) || replace(substr({runs}, 2), '0', ''), 4, '0') END"


# Lookaheads as groups that are put back; where matches may touch, the rule stands twice.
G_BEFORE_FRONT = ("([^g]|^)g([iey])", "$1J$2")
AFTER_FIRST = ("(.)sch", "$1SK")
GLIDE = ("[wy]([^aeiou]|$)", "$1")
METAPHONE = [
    *((f"{c}{{2,}}", c) for c in "bcdfhjklmnpqrstvwxyz"), ("^ae", "E"), ("^[gkp]n", "N"), ("^wr", "R"), ("^x", "S"), ("^wh", "W"), ("mb$", "M"), AFTER_FIRST, AFTER_FIRST, ("th", "0"), ("t?ch|sh", "X"),
    ("c(ia)", "X$1"), ("[st](i[ao])", "X$1"), ("s?c([iey])", "S$1"), ("[cq]", "K"), ("dg([iey])", "J$1"), ("d", "T"), ("g(h[^aeiou])", "$1"), ("gn(ed)?", "N"), G_BEFORE_FRONT, G_BEFORE_FRONT,
    ("g+", "K"), ("ph", "F"), ("([aeiou])h([^aeiou]|$)", "$1$2"), GLIDE, GLIDE, GLIDE, ("z", "S"), ("v", "F"), ("(.)[aeiou]+", "$1"),
]


def caverphone(revisited: bool) -> str:
    p = phonetics
    rules = [*p.CAVERPHONE_HEAD, *(p.CAVERPHONE_REVISITED if revisited else p.CAVERPHONE_ORIGINAL), *p.CAVERPHONE_MIDDLE, ("j" if revisited else "i", "y"), *p.CAVERPHONE_TAIL]
    return f"rpad({chain('word', [(a, b.replace('$12f', '$1' + '2f')) for a, b in rules])}, 10, '1')"


def phonetic_rules(words: str) -> str:
    """words: a WITH list that ends in u (word, u)."""
    p = phonetics
    one = {
        "caverphone": caverphone(False), "caverphone2": caverphone(True), "metaphone": f"upper({chain('word', METAPHONE)})", "soundex": soundex("u"),
        "n1": chain("u", p.NYSIIS_FIRST), "n2": chain("u", p.NYSIIS_REFINED_FIRST), "m": squeezed("(substr(u, 1, 1) || regexp_replace(substr(u, 2), '[AEIOU]', '', 'g'))"),
        "d": f"translate(u, '{p.FRENCH_LETTERS}', '{p.FRENCH_CODES}')", "x": f"translate({chain('u', p.FRENCH_PHONEX)}, 'ADPJBVM', 'OTTGFFN')",
        "s1": chain("u", p.SOUNDEX2_GROUPS), "g": f"translate({chain('u', p.PHONEM)}, '{p.PHONEM_LETTERS[0]}', '{p.PHONEM_LETTERS[1]}')",
    }
    rules2 = [*p.SOUNDEX2_PREFIXES, ("([^CS])H", "$1"), ("([^A])Y", "$1"), ("[ADTS]$", "")]
    two = {
        "nysiis": f"substr(n1, 1, 1) || {squeezed(chain('substr(n1, 2)', p.NYSIIS_SECOND))}", "nysiis_refined": f"substr(n2, 1, 1) || {squeezed(chain('n2', p.NYSIIS_REFINED_SECOND))}",
        "mra": "substr(m, 1, 3) || CASE WHEN len(m) > 3 THEN right(m, least(3, len(m) - 3)) ELSE '' END", "t": "replace(substr(d, 2), 'D', '')",
        "french_phonex": chain(squeezed("x", LETTERS + "0123456789"), [("[TX]$", "")]), "s2": chain("(substr(s1, 1, 1) || regexp_replace(substr(s1, 2), '[AEIOU]', 'A', 'g'))", rules2),
        "phonem": f"regexp_replace({squeezed('g', LETTERS + 'Ö§')}, '[^ABCDLMNORSUVWXYÖ]', '', 'g')",
    }
    tail = "CASE WHEN substr(t, 1, 1) = substr(d, 1, 1) THEN substr(t, 2) ELSE t END"
    three = {
        "onca": soundex("nysiis"), "french_soundex": f"rpad(substr(u, 1, 1) || replace({squeezed(f'({tail})', '0123456789')}, '0', ''), 4, '0')",
        "soundex2": f"substr({squeezed("(substr(s2, 1, 1) || replace(substr(s2, 2), 'A', ''))")}, 1, 4)",
    }
    with_ = ", ".join(f"{b} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM {a})" for a, b, cols in (("u", "r1", one), ("r1", "r2", two), ("r2", "r3", three)))
    out = "word caverphone caverphone2 metaphone soundex nysiis nysiis_refined mra onca french_soundex soundex2 french_phonex phonem".split()
    return f"{words}, {with_} SELECT {', '.join(out)} FROM r3"


def keyers_all() -> str:
    """K5-K7, K9 and K10 of the distinct part names."""
    k, order = keyers, keyers.OMISSION_ORDER
    signature = chain(f"regexp_replace(lower(name), '(?i)(?:{k.SIGNATURE_TITLES})\\.?\\s+', '', 'g')", [("[^a-z]", ""), (r"(\S)[aeiou]+", "$1"), ("[jz]", "g"), ("[qc]", "k")])
    some = " || ".join(f"CASE WHEN contains(u, '{c}') THEN '{c}' ELSE '' END" for c in order)
    # distinct letters in order of appearance
    distinct = lambda x: f"list_filter(string_split({x}, ''), lambda c, i: list_position(string_split({x}, ''), c) = i AND c <> '')"
    rest = f"list_filter({distinct('u')}, lambda c: c <> substr(u, 1, 1))"
    rules = [(r"\bmc(\w)", "mac$1"), (r"\b(ma?c\s+)(\w)", "mac$2"), *tokens.NAME_RULES[2:]]
    words = chain(f"replace({chain('lower(name)', rules)}, '-', ' ')", [("(?i)(?:" + "|".join(rf"\b{w}\b" for w in tokens.NAME_STOPWORDS) + ")", ""), (r"\d", ""), ("[[:punct:]]", "")])
    split = f"list_sort(list_distinct(string_split_regex(trim({words}), '\\s+')))"
    return (
        f"WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, regexp_replace(upper(name), '[^A-Z]', '', 'g') AS u, len(list_distinct(string_split_regex(trim(name), '\\s+'))) AS k FROM n) "
        f"SELECT name, array_to_string(list_transform({split}, lambda w: {squeezed('w', LETTERS.lower())}), ' ') AS fingerprint, {signature} AS signature, {some} || array_to_string({distinct(f"regexp_replace(u, '[{order}]', '', 'g')")}, '') AS omission, "
        f"substr(u, 1, 1) || array_to_string(list_filter({rest}, lambda c: NOT contains('AEIOU', c)), '') || array_to_string(list_filter({rest}, lambda c: contains('AEIOU', c)), '') AS skeleton, "
        f"CASE WHEN k < 2 THEN 1 ELSE CAST(pow(3, k) - pow(2, k) - k AS BIGINT) END AS sets FROM c"
    )


def treebank(x: str) -> str:
    """Words of the Penn treebank, as an array."""
    t = tokens
    out = f"(' ' || {chain(x, [*t.TREEBANK_STARTS, *t.TREEBANK_MARKS, *t.TREEBANK_BRACKETS])} || ' ')"
    return f"string_split_regex({chain(out, [*t.TREEBANK_ENDS, *t.TREEBANK_CONTRACTIONS, (r'^\s+|\s+$', '')])}, '\\s+')"


def porter(words: str) -> str:
    """words: a WITH list that ends in u; the Porter stemmer step by step."""
    c, v = "[^aeiou]", "[aeiouy]"
    m1, m2, once, short = f"^{c}*{v}+{c}+", f"^{c}*{v}+{c}+{v}+{c}+", f"^{c}*{v}+{c}+{v}*$", f"^{c}+{v}[^aeiouwxy]$"
    cut = lambda n: f"left(s, len(s) - {n})"
    has = lambda x, pattern: f"regexp_matches({x}, {quoted(pattern)})"
    ends = lambda e: f"(s LIKE '%{e}' AND len(s) > {len(e)})"
    double = has("s", "(" + "|".join(f"{x}{x}" for x in "bcdfghjkmnpqrtvwx") + ")$")

    def table(t: dict) -> str:
        by = sorted(t, key=len, reverse=True)  # the longest that ends the word decides
        return "CASE " + " ".join(f"WHEN {ends(e)} THEN CASE WHEN {has(cut(len(e)), m1)} THEN {cut(len(e))} || '{t[e]}' ELSE s END" for e in by) + " ELSE s END"

    fourth = " ".join(f"WHEN {ends(e)} THEN CASE WHEN {has(cut(len(e)), m2)} THEN {cut(len(e))} ELSE s END" for e in sorted(stemmers.PORTER_4, key=len, reverse=True))
    steps = [
        "CASE WHEN word LIKE 'y%' THEN 'Y' || substr(word, 2) ELSE word END",
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {has('s', '..*[^s]s$')} THEN {cut(1)} ELSE s END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {has(cut(3), m1)} THEN {cut(1)} ELSE s END WHEN {ends('ing')} AND {has(cut(3), f'^{c}*{v}')} THEN '#' || {cut(3)} WHEN {ends('ed')} AND {has(cut(2), f'^{c}*{v}')} THEN '#' || {cut(2)} ELSE s END",
    ]
    # '#' marks a word that has lost -ed or -ing
    after = (
        f"CASE WHEN NOT marked THEN s WHEN {has('s', '(at|bl|iz)$')} OR ({has('s', short)} AND NOT {double}) THEN s || 'e' WHEN {double} THEN {cut(1)} ELSE s END",
        f"CASE WHEN s LIKE '%y' AND {has(cut(1), v)} THEN {cut(1)} || 'i' ELSE s END", table(stemmers.PORTER_2), table(stemmers.PORTER_3),
        f"CASE {fourth} WHEN ({ends('sion')} OR {ends('tion')}) AND len(s) > 4 AND {has(cut(3), m2)} THEN {cut(3)} ELSE s END",
        f"CASE WHEN s LIKE '%e' AND len(s) > 1 AND ({has(cut(1), m2)} OR ({has(cut(1), once)} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE s END",
        f"CASE WHEN s LIKE '%ll' AND {has('s', m2)} THEN {cut(1)} ELSE s END",
    )
    sql, last = f"{words}, p0 AS (SELECT word, {steps[0]} AS s FROM u)", 0
    for step in steps[1:]:
        sql, last = f"{sql}, p{last + 1} AS (SELECT word, {step} AS s FROM p{last})", last + 1
    sql, last = f"{sql}, p{last + 1} AS (SELECT word, s LIKE '#%' AS marked, ltrim(s, '#') AS s FROM p{last})", last + 1
    for step in after:
        sql, last = f"{sql}, p{last + 1} AS (SELECT word, marked, {step} AS s FROM p{last})", last + 1
    return f"{sql} SELECT word, CASE WHEN len(word) < 3 THEN word ELSE lower(s) END AS porter FROM p{last}"


def schinke(words: str) -> str:
    """The Schinke stemmer: noun and verb stems."""
    st = stemmers
    noun = " ".join(f"WHEN s LIKE '%{e}' THEN left(s, len(s) - {len(e)})" for e in st.SCHINKE_NOUN)
    verb = " ".join(f"WHEN s LIKE '%{e}' THEN " + (f"CASE WHEN len(s) > {len(e) + 1} THEN left(s, len(s) - {len(e)}) || '{i}' ELSE s END" if i else f"left(s, len(s) - {len(e)})") for e, i in st.SCHINKE_VERB)
    que = ", ".join(f"'{w}'" for w in sorted(st.SCHINKE_QUE))
    return (
        f"{words}, a AS (SELECT word, translate(word, 'jv', 'iu') AS w FROM u), b AS (SELECT word, w, w IN ({que}) AS whole, CASE WHEN w LIKE '%que' THEN left(w, len(w) - 3) ELSE w END AS s FROM a), "
        f"d AS (SELECT *, CASE {noun} ELSE s END AS n, CASE {verb} ELSE s END AS v FROM b) "
        "SELECT word, CASE WHEN whole THEN w WHEN len(n) > 1 THEN n ELSE s END AS noun, CASE WHEN whole THEN w WHEN len(v) > 1 THEN v ELSE s END AS verb FROM d"
    )


def eda(words: str) -> str:
    """words: a WITH list that ends in u (word); the EDA stemmer, whose endings are tried one after the other."""
    last = lambda x: f"regexp_replace(regexp_replace({x}, 'e$', ''), 's$', '')"
    plain = squeezed("replace(strip_accents(lower(word)), 'œ', 'oe')", LETTERS.lower())
    sql = f"{words}, e0 AS (SELECT word, {plain} AS s FROM u), e1 AS (SELECT word, CASE WHEN len(s) <= 5 THEN {last('s')} ELSE replace(regexp_replace(s, 'cqu|qu|ck?', 'k', 'g'), 'y', 'i') END AS s, len(s) <= 5 AS done FROM e0)"
    for k, e in enumerate(stemmers.EDA, 1):
        cut = f"left(s, len(s) - {len(e)})"
        hit = f"NOT done AND s LIKE '%{e}'"
        sql += f", e{k + 1} AS (SELECT word, CASE WHEN {hit} THEN CASE WHEN len(s) <= {5 + len(e)} THEN {last(cut)} ELSE {cut} END ELSE s END AS s, done OR ({hit} AND len(s) <= {5 + len(e)}) AS done FROM e{k})"
    return f"{sql} SELECT word, s AS stem FROM e{len(stemmers.EDA) + 1}"


def spanish_singular(x: str) -> str:
    """Of words in lower case: the first rule that fits."""
    st = stemmers
    same, odd = ", ".join(f"'{w}'" for w in sorted(st.SPANISH_SAME)), " ".join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in st.SPANISH_IRREGULAR.items())
    marked = f"left({x}, len({x}) - 4) || translate(substr({x}, len({x}) - 3, 1), 'aeiou', 'áéíóú') || substr({x}, len({x}) - 2, 1)"
    rules = " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN " + (f"regexp_replace({x}, {quoted(p)}, {quoted(to)})" if to is not None else marked) for p, to in st.SPANISH_RULES)
    return f"CASE WHEN {x} IN ({same}) THEN {x} {odd} {rules} ELSE {x} END"


def mra_codex(x: str) -> str:
    m = squeezed(f"(substr({x}, 1, 1) || regexp_replace(substr({x}, 2), '[AEIOU]', '', 'g'))")
    return f"substr({m}, 1, 3) || CASE WHEN len({m}) > 3 THEN right({m}, least(3, len({m}) - 3)) ELSE '' END"


def mra(pairs: str) -> str:
    """pairs: a WITH list that ends in pairs (a, b); the match rating comparison, where codices differ in length by three at most."""
    upper = lambda c: f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    kept = lambda c: f"reverse(array_to_string(list_transform(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda k: substr(x, k, 1) <> substr(y, k, 1)), lambda k: substr({c}, k, 1)), ''))"
    return (
        f"{pairs}, m0 AS (SELECT a, b, {mra_codex('u')} AS x, {mra_codex('v')} AS y FROM (SELECT a, b, {upper('a')} AS u, {upper('b')} AS v FROM pairs)), m1 AS (SELECT a, b, x AS codex_a, y AS codex_b, {kept('x')} AS x, {kept('y')} AS y FROM m0 WHERE abs(len(x) - len(y)) <= 3), "
        f"m2 AS (SELECT a, b, codex_a, codex_b, CASE WHEN len(codex_a) + len(codex_b) <= 4 THEN 5 WHEN len(codex_a) + len(codex_b) <= 7 THEN 4 WHEN len(codex_a) + len(codex_b) <= 11 THEN 3 ELSE 2 END AS minimum, 6 - greatest(len({kept('x')}), len({kept('y')})) AS similarity FROM m1) "
        "SELECT a, b, codex_a, codex_b, CAST(minimum AS INTEGER) AS minimum, CAST(similarity AS INTEGER) AS similarity, similarity >= minimum AS matching FROM m2"
    )


def guth(pairs: str) -> str:
    at = lambda s, k: f"nullif(substr({s}, i + {k}, 1), '')"  # noqa: E731  # i from 1
    same = lambda x, y: f"coalesce({x} = {y}, FALSE)"
    ok = " OR ".join(same(at("s", j), at("l", k)) if j or k else same(at("s", 0), at("l", 0)) for j, k in ((0, 0), (0, 1), (0, 2), (0, -1), (-1, 0), (1, 0), (2, 0), (1, 1), (2, 2)))
    missed = f"len(list_filter(range(1, len(l) + 1), lambda i: i > len(s) + 2 OR NOT ({ok})))"
    return f"{pairs}, o AS (SELECT a, b, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM pairs) SELECT a, b, CAST({missed} AS INTEGER) AS guth FROM o"


#: Local alignments, by a fold over the cells of the table.
SMITH_WATERMAN = (
    "CAST(list_max(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(0, (len(a) + 1) * (len(b) + 1)), lambda n: [n])), lambda acc, z: list_append(acc, "
    "CASE WHEN z[1] <= len(b) OR z[1] % (len(b) + 1) = 0 THEN 0 ELSE greatest(0, acc[z[1] - len(b) - 1] + CASE WHEN substr(a, z[1] // (len(b) + 1), 1) = substr(b, z[1] % (len(b) + 1), 1) THEN 1 ELSE 0 END, acc[z[1] - len(b)] - 1, acc[z[1]] - 1) END))) AS DOUBLE)"
)

#: Optimal string alignment, likewise.
SWAP = (
    "CASE WHEN z[1] // (len(b) + 1) > 1 AND z[1] % (len(b) + 1) > 1 AND substr(a, z[1] // (len(b) + 1), 1) = substr(b, z[1] % (len(b) + 1) - 1, 1) "
    "AND substr(a, z[1] // (len(b) + 1) - 1, 1) = substr(b, z[1] % (len(b) + 1), 1) THEN acc[z[1] - 2 * len(b) - 3] + 1 ELSE 1000 END"
)
ALIGNMENT = (
    "list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(0, (len(a) + 1) * (len(b) + 1)), lambda n: [n])), lambda acc, z: list_append(acc, "
    "CASE WHEN z[1] // (len(b) + 1) = 0 THEN z[1] WHEN z[1] % (len(b) + 1) = 0 THEN z[1] // (len(b) + 1) ELSE least(acc[z[1] - len(b)] + 1, acc[z[1]] + 1, "
    f"acc[z[1] - len(b) - 1] + CASE WHEN substr(a, z[1] // (len(b) + 1), 1) = substr(b, z[1] % (len(b) + 1), 1) THEN 0 ELSE 1 END, {SWAP}) END))[-1]"
)

SPANISH_UNINE = (
    "CASE WHEN len(word) < 5 THEN word WHEN regexp_matches(word, '[oae]$') THEN left(word, len(word) - 1) WHEN word LIKE '%eses' THEN left(word, len(word) - 2) "
    "WHEN word LIKE '%ces' THEN left(word, len(word) - 3) || 'z' WHEN regexp_matches(word, '[oae]s$') THEN left(word, len(word) - 2) ELSE word END"
)

#: crc32 as a signed number: the table of 256 by eight shifts, then a fold over the bytes.
CRC32 = (
    "WITH RECURSIVE t(n, c, k) AS (SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8), "
    "crc AS (SELECT list(c ORDER BY n) AS f FROM t WHERE k = 8), n AS (SELECT DISTINCT p_name AS name FROM part), "
    "b AS (SELECT name, list_transform(range(1, strlen(name) + 1), lambda i: CAST(('0x' || substr(hex(name), 2 * i - 1, 2)) AS BIGINT)) AS bytes FROM n), "
    "h AS (SELECT name, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(f[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM b, crc) "
    "SELECT name, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS crc32 FROM h"
)


def stars(edges: str, ids: str = "SELECT a AS id FROM e UNION SELECT b FROM e") -> str:
    """Greedy star clusters of e (a, b), a < b: ids in order lead unless an earlier leader is their neighbour; (cluster_id, pos, id)."""
    return (
        f"{edges}, x AS (SELECT list(id ORDER BY id) AS ids FROM ({ids})), g AS (SELECT list(a * 10000000 + b) AS pairs FROM e), "
        "l AS (SELECT unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ids, lambda i: [i])), lambda acc, i: CASE WHEN len(list_filter(acc, lambda h: list_contains(pairs, h * 10000000 + i[1]))) > 0 THEN acc ELSE list_concat(acc, i) END)) AS id FROM x, g), "
        "ways AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), m AS (SELECT l.id AS cluster_id, dst AS id FROM l JOIN ways ON src = l.id UNION SELECT id, id FROM l) "
        "SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY id <> cluster_id, id) - 1 AS INTEGER) AS pos, id FROM m"
    )
