"""Punkt: unsupervised sentence boundaries. Training is a plan of counts over tokens; applying is a kernel with the model.

Tokens never become rows: a kernel reads texts one by one and sends counts on, of token types first and then, with the
abbreviations known, of what stands beside what. It keeps at most HELD counts before it does, so neither texts nor
vocabulary decide what a task holds. How types are written elsewhere (contexts) grows with the vocabulary: split() joins
to a text those it asks for. The rest of a model is small beside the corpus, and its size is checked before it travels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.udfs import kernel_column
from kindred.plans.scratch import Scratch

# Fixed values of the method: thresholds, context flags, and what ends sentences and words.
ABBREVIATION, BACKOFF, COLLOCATION, STARTER = 0.3, 5, 7.88, 30.0
BEG_UC, MID_UC, UNK_UC, BEG_LC, MID_LC, UNK_LC = 2, 4, 8, 16, 32, 64
UPPER_ANY, LOWER_ANY = BEG_UC | MID_UC | UNK_UC, BEG_LC | MID_LC | UNK_LC
NOT_IN_WORD, MULTI, START = r"(?:[?!)\";}\]*:@'({\[])", r"(?:-{2,}|\.{2,}|(?:\.\s){2,}\.)", r"[^(\"`{\[:;&#*@)}\]\-,]"
WORD = re.compile(rf"{MULTI}|(?={START})\S+?(?=\s|$|{NOT_IN_WORD}|{MULTI}|,(?=$|\s|{NOT_IN_WORD}|{MULTI}))|\S")
SPREAD = re.compile(r"\.\s\.\s\.")  # the one token with white space in it
CONTEXT = re.compile(rf"\S*[.?!](?=({NOT_IN_WORD}|\s+(\S+)))")
MARK, SPACE = re.compile(r"[.?!]"), re.compile(r"\s|\Z")
REALIGN = re.compile(r"[\"')\]}]+?(?:\s+|(?=--)|$)")
NUMBER = re.compile(r"^-?[.,]?\d[\d,.\-]*\.?$")
INITIAL, ELLIPSIS = re.compile(r"[^\W\d]\.$"), re.compile(r"\.\.+$")
MAX_MODEL = 2_000_000  # entries of a model at most
HELD, KNOWN, PORTION = 200_000, 1 << 16, 1 << 20  # counts, tokens and characters of texts that a kernel holds at once


@dataclass(frozen=True)
class Token:
    text: str

    @cached_property
    def type(self) -> str:
        return NUMBER.sub("##number##", self.text.lower())

    @cached_property
    def bare(self) -> str:
        """The type without a final point."""
        return self.type[:-1] if len(self.type) > 1 and self.type.endswith(".") else self.type

    @cached_property
    def point(self) -> bool:
        return self.text.endswith(".")

    @cached_property
    def number(self) -> bool:
        return self.type.startswith("##number##")

    @cached_property
    def initial(self) -> bool:
        return bool(INITIAL.match(self.text))

    @cached_property
    def ellipsis(self) -> bool:
        return bool(ELLIPSIS.match(self.text))

    @cached_property
    def case(self) -> str:
        c = self.text[:1]
        return "upper" if c.isupper() else "lower" if c.islower() else ""

    def marks(self, abbreviations) -> tuple[bool, bool]:
        """Whether it ends a sentence and whether it is an abbreviation, by itself."""
        if self.text in (".", "?", "!"):
            return True, False
        if self.ellipsis or not self.point or self.text.endswith(".."):
            return False, False
        low = self.text[:-1].lower()
        short = low in abbreviations or low.split("-")[-1] in abbreviations
        return not short, short

    def ending(self, breaks: bool) -> str:
        """The type, without its point where it ends a sentence."""
        return self.bare if breaks else self.type


@lru_cache(KNOWN)
def token(text: str) -> Token:
    return Token(text)


pieces = lru_cache(KNOWN)(WORD.findall)


def line_tokens(line: str) -> list[str]:
    """The tokens of a line: those of its parts between white space, unless one spreads over them. Most are words, with a
    point or comma at most."""
    if SPREAD.search(line):
        return WORD.findall(line)
    out = []
    for chunk in line.split():
        if chunk.isalpha():
            out.append(chunk)
        elif chunk[-1] == "." and chunk[:-1].isalpha():
            out.append(chunk)
        elif chunk[-1] == "," and chunk[:-1].isalpha():
            out += chunk[:-1], ","
        else:
            out += pieces(chunk)
    return out


def lines(text: str) -> Iterator[tuple[list[str], bool]]:
    """The tokens of each line that has any, and whether a paragraph begins there."""
    paragraph = False
    for line in text.split("\n"):
        if found := line_tokens(line):
            yield found, paragraph
        paragraph = not found


def tokens(text: str) -> list[Token]:
    return [token(t) for found, _ in lines(text) for t in found]


@dataclass
class Model:
    abbreviations: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    contexts: dict[str, int] = field(default_factory=dict)


def dunning(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood that a type is one with a point nearly always, against chance."""
    p1, p2 = b / n, F.lit(0.99)
    term = lambda p: both * F.log(p) + (a - both) * F.log(1 - p)
    return -2 * (F.coalesce(term(p1), F.lit(0.0)) - term(p2))


def likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood that two events go together."""
    p, p1, p2 = b / n, both / a, F.when(n == a, 1.0).otherwise((b - both) / F.when(n == a, 1).otherwise(n - a))
    term = lambda k, m, q: F.when((q <= 0) | (q >= 1), 0.0).otherwise(k * F.log(q) + (m - k) * F.log(1 - q))
    first = term(both, a, p) + term(b - both, n - a, p)
    return -2 * (first - F.when(a == both, 0.0).otherwise(term(both, a, p1)) - F.when(b == both, 0.0).otherwise(term(b - both, n - a, p2)))


def texts_of(batch: pa.RecordBatch, column: int = 0) -> Iterator[str | None]:
    for k in range(batch.num_rows):
        yield batch.column(column)[k].as_py()


def emptied(counts: dict, rows: Callable[[dict], pa.RecordBatch], limit: int = 0) -> Iterator[pa.RecordBatch]:
    """The counts as rows, if there are more than limit, which are then forgotten."""
    if len(counts) > limit:
        yield rows(counts)
        counts.clear()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, k, points) of texts: how often a type is there, and how often with a point."""
    counts: Counter[str] = Counter()

    def rows(counts: Counter) -> pa.RecordBatch:
        types: dict[str, list[int]] = {}
        for line, k in counts.items():
            for text in line_tokens(line):
                row = types.setdefault(text.lower() if text.isalpha() else token(text).type, [0, 0])
                row[0] += k
                row[1] += k * text.endswith(".")
        k, points = zip(*types.values(), strict=True) if types else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(types, pa.string()), pa.array(k, pa.int64()), pa.array(points, pa.int64())], ["type", "k", "points"])

    for batch in batches:
        for text in texts_of(batch):
            for line in text.split("\n"):
                counts.update([line] if SPREAD.search(line) else line.split())
            yield from emptied(counts, rows, HELD)
    yield from emptied(counts, rows)


UPPER_FLAGS, LOWER_FLAGS = {"initial": BEG_UC, "internal": MID_UC, "unknown": UNK_UC}, {"initial": BEG_LC, "internal": MID_LC, "unknown": UNK_LC}
COMMA, LOWER = 1, 2


def beside(abbreviations: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kind, a, b, n) of texts. context: an ending and the flags it is met with; rare: the ending of a sentence, the next
    token's and what that one begins with; start: a type after the end of a sentence, counted; met: what is before a point
    of a number or initial and the next ending, counted; break: ends of sentences, counted."""

    def place(text: str) -> tuple[Token, bool, str, str]:
        t = token(text)
        brk, abbr = t.marks(abbreviations)
        left = ("unknown" if t.number or t.initial else "initial") if brk else "unknown" if t.ellipsis or abbr else "internal"
        return t, brk, t.ending(brk), left

    def rows(counts: dict) -> pa.RecordBatch:
        columns = zip(*((*k, n) for k, n in counts.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "a", "b", "n"])

    def context_rows(flags: dict) -> pa.RecordBatch:
        return rows({("context", ending, ""): bits for ending, bits in flags.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str]] = Counter()
        flags: dict[str, int] = {}
        placed = lru_cache(KNOWN)(place)
        for batch in batches:
            for text in texts_of(batch):
                before, last, left = None, "", "internal"  # the token before, if it ends a sentence with a point
                for found, paragraph in lines(text):
                    left = "initial" if paragraph and left != "unknown" else "unknown" if left == "internal" else left
                    for word in found:
                        if word.isalpha():  # a plain word, which most are
                            t, ends, ending, after = None, False, word.lower(), "internal"
                        else:
                            t, ends, ending, after = placed(word)
                        flag = UPPER_FLAGS[left] if word[0].isupper() else LOWER_FLAGS[left] if word[0].islower() else 0
                        if flag:
                            flags[ending] = flags.get(ending, 0) | flag
                        if before:
                            if bits := COMMA * (word[0] in ",:;") | LOWER * word[0].islower():
                                counts["rare", last, ending] |= bits
                            counts[("met", before.bare, ending) if before.number or before.initial else ("start", t.type if t else ending, "")] += 1
                        if ends:
                            counts["break", "", ""] += 1
                        before, last, left = t if ends and t.point else None, ending, after
                yield from emptied(counts, rows, HELD)
                yield from emptied(flags, context_rows, HELD)
        yield from emptied(counts, rows)
        yield from emptied(flags, context_rows)

    return run


@dataclass
class Learned:
    """What a corpus teaches, as tables: (short), (bare, next_ending), (next_type), (ending, flags)."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame
    contexts: DataFrame


def learn(docs: DataFrame, text_col: str = "text") -> Learned:
    """The tables of a corpus, of any size; texts are tokenised whole, each by itself."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)
    types = texts.mapInArrow(counted, "type string, k long, points long").groupBy("type").agg(F.sum("k").alias("k"), F.sum("points").alias("points"))
    types = scratch.freeze(types, "types")
    sizes = types.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")).first()
    n = F.lit(float(sizes["n"]))
    plain = types.select(F.col("type").alias("bare"), F.col("k").alias("without"))
    count_of = lambda c: types.select(F.col("type").alias(c), F.col("k").alias(f"k_{c}"))

    # abbreviations: types with a point whose point is part of them
    pointed = types.where("type LIKE '%.' AND type RLIKE '[^\\\\W\\\\d_]' AND type <> '##number##'").select(F.expr("substring(type, 1, length(type) - 1)").alias("bare"), F.col("k").alias("with"))
    both = pointed.join(plain, "bare", "left").withColumn("without", F.coalesce("without", F.lit(0)))
    inner = F.length("bare") - F.length(F.replace("bare", F.lit("."), F.lit(""))) + 1
    letters = F.length("bare") - inner + 1
    score = dunning(F.col("with") + F.col("without"), F.lit(float(sizes["points"])), F.col("with"), n) * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -F.col("without"))
    short = scratch.freeze(both.where((letters > 0) & (score >= ABBREVIATION)).select(F.col("bare").alias("short")).distinct(), "short")

    # what stands beside what, once each token's marks are known
    seen = texts.mapInArrow(beside(frozenset(r[0] for r in collected(short))), "kind string, a string, b string, n long")
    seen = seen.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.expr("bit_or(n)").alias("bits"))
    seen = scratch.freeze(seen, "seen")
    of = lambda kind, *columns: seen.where(F.col("kind") == kind).select(*columns)
    contexts = of("context", F.col("a").alias("ending"), F.col("bits").cast("int").alias("flags"))
    breaks = max(1, of("break", F.sum("n")).first()[0] or 0)

    follow = contexts.select(F.col("ending").alias("next_ending"), F.col("flags").alias("next_flags"))
    rare = of("rare", F.col("a").alias("ending"), F.col("b").alias("next_ending"), "bits").join(count_of("ending"), "ending", "left").withColumn("cut", F.expr("substring(ending, 1, length(ending) - 1)")).join(count_of("cut"), "cut", "left")
    few = F.coalesce("k_ending", F.lit(0)) + F.coalesce("k_cut", F.lit(0)) < BACKOFF
    inside = (F.col("bits").bitwiseAND(LOWER) > 0) & (F.col("next_flags").bitwiseAND(BEG_UC) > 0) & (F.col("next_flags").bitwiseAND(MID_UC) == 0)
    rare = rare.where(few).join(follow, "next_ending", "left").where((F.col("bits").bitwiseAND(COMMA) > 0) | inside).select(F.col("ending").alias("short")).distinct()

    starts = of("start", F.col("a").alias("next_type"), F.col("n").alias("at_break")).where("next_type RLIKE '^[^\\\\W\\\\d]+$'")
    starts = starts.join(count_of("next_type"), "next_type", "left").join(types.select(F.expr("substring(type, 1, length(type) - 1)").alias("next_type"), F.col("k").alias("k_point"), F.col("type").endswith(".").alias("p")).where("p"), "next_type", "left")
    k = F.coalesce("k_next_type", F.lit(0)) + F.coalesce("k_point", F.lit(0))
    starts = starts.where((k >= F.col("at_break")) & (likelihood(F.lit(float(breaks)), k, F.col("at_break"), n) >= STARTER) & (n / breaks > k / F.col("at_break"))).select("next_type")
    starts = scratch.freeze(starts, "starters")

    def with_points(name: str) -> DataFrame:
        """Counts of a type with and without a point."""
        stem = F.when(F.col("type").endswith(".") & (F.length("type") > 1), F.expr("substring(type, 1, length(type) - 1)")).otherwise(F.col("type"))
        return types.select(stem.alias(name), "k").groupBy(name).agg(F.sum("k").alias(f"all_{name}"))

    words = "[^\\\\W\\\\d]"
    met = of("met", F.col("a").alias("bare"), F.col("b").alias("next_ending"), F.col("n").alias("met")).where(f"bare RLIKE '{words}|##number##' AND next_ending RLIKE '{words}'")
    met = met.join(with_points("bare"), "bare").join(with_points("next_ending"), "next_ending").join(starts.withColumnRenamed("next_type", "next_ending"), "next_ending", "left_anti")
    a, b = F.col("all_bare"), F.col("all_next_ending")
    met = met.where((a > 1) & (b > 1) & (F.col("met") > 1) & (F.col("met") <= F.least(a, b)))
    met = met.where((likelihood(a, b, F.col("met"), n) >= COLLOCATION) & (n / a > b / F.col("met"))).select("bare", "next_ending")
    return Learned(scratch.freeze(short.union(rare).distinct(), "abbreviations"), scratch.freeze(met, "collocations"), starts, contexts)


def collected(*parts: DataFrame) -> list:
    """All rows of small tables; their size is checked before."""
    size = sum(p.count() for p in parts)
    if size > MAX_MODEL:
        raise ValueError(f"a model of {size} entries is too large to travel with the kernel")
    return [r for p in parts for r in p.collect()] if len(parts) == 1 else [p.collect() for p in parts]


def train(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> Model:
    """The model of a corpus, if it is small enough for one place; id_col is not needed, as each text is by itself."""
    x = learn(docs, text_col)
    s, m, st, c = collected(x.abbreviations, x.collocations, x.starters, x.contexts)
    return Model({r[0] for r in s}, {(r[0], r[1]) for r in m}, {r[0] for r in st}, {r["ending"]: r["flags"] for r in c})


def split(docs: DataFrame, learned: Learned, text_col: str = "text", name: str = "sentences") -> DataFrame:
    """docs with the sentences of a text; contexts meet texts in a join, by what a text asks of them."""
    s, m, st = collected(learned.abbreviations, learned.collocations, learned.starters)
    punkt = Punkt(Model({r[0] for r in s}, {(r[0], r[1]) for r in m}, {r[0] for r in st}))

    def rows(pairs: dict) -> pa.RecordBatch:
        texts, endings = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(endings, pa.string())], ["__text", "ending"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[bytes, str], None] = {}
        for batch in batches:
            for key, text in zip(texts_of(batch), texts_of(batch, 1), strict=True):
                pairs |= dict.fromkeys((key, follow) for m in contexts_of(text) for follow in punkt.follows(m[0] + m[1]))
                yield from emptied(pairs, rows, HELD)
        yield from emptied(pairs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, size, out = batch.schema.get_field_index(text_col), 0, 0, []
            for k in range(batch.num_rows):
                text = batch.column(at)[k].as_py()
                found = batch.column(batch.num_columns - 1)[k].as_py()
                out.append(None if text is None else Punkt(Model(punkt.model.abbreviations, punkt.model.collocations, punkt.model.starters, {f["ending"]: f["flags"] for f in found or ()}))(text))
                size += len(text or "")
                if size > PORTION or k + 1 == batch.num_rows:
                    part = batch.slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.list_(pa.string()))], [*kept, name])
                    first, size, out = k + 1, 0, []

    kept = docs.columns
    keyed = docs.withColumn("__text", F.unhex(F.md5(text_col)))
    # an ending that is never in lower case decides as one that is not there
    telling = learned.contexts.where(F.col("flags").bitwiseAND(LOWER_ANY) > 0)
    found = keyed.where(F.col(text_col).isNotNull()).select("__text", text_col).mapInArrow(asked, "__text binary, ending string").distinct()
    found = found.join(telling, "ending").groupBy("__text").agg(F.collect_list(F.struct("ending", "flags")).alias("__flags"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return keyed.join(found, "__text", "left").select(*kept, "__flags").mapInArrow(run, f"{schema}, `{name}` array<string>")


def contexts_of(text: str) -> Iterator[re.Match]:
    """The matches of CONTEXT, tried only where a run without white space has a mark, so that long runs cost no more."""
    done = 0
    for mark in MARK.finditer(text):
        if mark.start() < done:
            continue
        begin = mark.start()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        while m := CONTEXT.match(text, begin):
            yield m
            begin = m.end()
        done = SPACE.search(text, max(begin, mark.end())).start()


class Punkt:
    """Sentences of a text under a model."""

    def __init__(self, model: Model):
        self.model = model

    def guess(self, token: Token, ending: str) -> bool | None:
        """Whether a token begins a sentence, by how its type is written elsewhere; None: cannot tell."""
        if token.text in (";", ":", ",", ".", "!", "?"):
            return False
        flags = self.model.contexts.get(ending, 0)
        if token.case == "upper" and flags & LOWER_ANY and not flags & MID_UC:
            return True
        if token.case == "lower" and (flags & UPPER_ANY or not flags & BEG_LC):
            return False
        return None

    def follows(self, context: str) -> Iterator[str]:
        """The endings whose contexts breaks() may ask for."""
        row = tokens(context)
        for one, two in zip(row, row[1:], strict=False):
            if one.point:
                yield two.ending(two.marks(self.model.abbreviations)[0])

    def breaks(self, context: str) -> bool:
        """Whether some token of a context but its last ends a sentence."""
        row = tokens(context)
        marks = [list(t.marks(self.model.abbreviations)) for t in row]
        for k in range(len(row) - 1):
            one, two = row[k], row[k + 1]
            if not one.point:
                continue
            brk, short = marks[k]
            follow = two.ending(marks[k + 1][0])
            if (one.bare, follow) in self.model.collocations:
                marks[k] = [False, True]
                continue
            begins = self.guess(two, follow)
            if (short or one.ellipsis) and not one.initial and (begins or (two.case == "upper" and follow in self.model.starters)):
                marks[k][0] = True
                continue
            if one.initial or one.bare == "##number##":
                lone = begins is None and one.initial and two.case == "upper" and not self.model.contexts.get(follow, 0) & LOWER_ANY
                if begins is False or lone:
                    marks[k] = [False, True]
        return any(m[0] for m in marks[:-1])

    def spans(self, text: str, realign: bool = True) -> list[tuple[int, int]]:
        out, begin = [], 0
        for m in contexts_of(text):
            if self.breaks(m[0] + m[1]):
                out.append((begin, m.end()))
                begin = m.start(2) if m[2] is not None else m.end()
        out.append((begin, len(text)))
        if realign:
            moved, shift = [], 0
            for k, (a, b) in enumerate(out):
                a += shift
                close = REALIGN.match(text[out[k + 1][0] : out[k + 1][1]]) if k + 1 < len(out) else None
                shift = close.end() if close else 0
                b = out[k + 1][0] + len(close[0].rstrip()) if close else b
                if a < b:
                    moved.append((a, b))
            out = moved
        return out

    def __call__(self, text: str, realign: bool = True) -> list[str]:
        return [text[a:b] for a, b in self.spans(text, realign)] if text else []


def sentences_column(model: Model, c) -> Column:
    return kernel_column(Punkt(model), "array<string>", c)
