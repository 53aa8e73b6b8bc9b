"""Small documents with everything that may come, and brute-force versions of the operators."""

from __future__ import annotations

import html
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def corpus(seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, __extra) rows: copies, near copies, shared passages, nulls, empty and long texts, repeats."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéß🔥", k=draw.randint(1, 7))) for _ in range(300)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, base = some(60), some(120)
    texts: list[str | None] = [" ".join(some(draw.randint(1, 200))) for _ in range(25)]
    texts += [" ".join([*some(30), *passage, *some(20)]) for _ in range(6)]
    texts += [" ".join(base)] * 4
    for _ in range(6):
        near = list(base)
        near[draw.randrange(len(near))] = "changed"
        texts.append("\n".join([" ".join(near), "tail"]))
    texts += [None, "", "   \n\t ", "one", "one two", "a" * 450, "ab " * 200, "\x00\x1c odd  spaces\u00a0here", " ".join(some(4000)), "x" * 199, "<|endoftext|> kept"]
    rows = [(i * 3 + 1, t, "en", i % 5) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[2], None, None), (10_000, texts[0] + " more", "fr", 1)]


SCHEMA = "doc_id long, text string, lang string, n_words int"


def substring_dedup(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept)."""
    split = [words(t) for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, *_), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix_dedup(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept)."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(x[i : i + size] for x in texts for i in range(len(x) - size + 1))
    out = []
    for (doc, *_), x in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((doc, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, size: int) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows: list[tuple], percent: int, size: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component)."""
    sets = {doc: shingles(t, size) for doc, t, *_ in rows if doc is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def likeness(a: str, b: str) -> float:
    """Generalised Jaccard similarity of word counts."""
    x, y = Counter(words(a)), Counter(words(b))
    most = sum(max(x[k], y[k]) for k in x | y)
    return sum((x & y).values()) / most if most else 1.0


def article(page: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", page, re.S)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner[1]))).split()) if inner else ""
