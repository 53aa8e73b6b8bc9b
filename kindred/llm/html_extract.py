"""HTML extraction with a site style tree."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

MIN_PAGES = 8  # different pages of a host that a node must be on before its importance counts
SAME = 0.3  # content entropy below which a branch is the same on most pages
PLAIN = 0.1  # what presentation counts at least in a node's importance, whose elements never vary
LESS = 0.5  # a branch is dropped below this part of the importance of the main branch beside it
TABLE_ROWS = 200_000  # bound on the nodes that are sent to every executor; more are joined by a shuffle

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element and word lists of HTML and of common page layouts.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
NOISE = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "svg", "canvas", "audio", "video", "map"}
NOISE_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
HEADS, HEAD_WORDS = {"header"}, {"header", "masthead", "topbar"}  # noise outside an article only
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar"}
FRAME = {"html", "body"}
SILENT = RAW | {"head"}  # their text is none of the page's
MAIN, MAIN_ROLES = {"article", "main"}, {"main", "article"}


@lru_cache(100_000)
def node_name(parent: int, label: str) -> int:
    """The name of a node of the style tree: of its parent and its tag, class and id words."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + label.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(20_000)
def described(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's label, and whether it is noise, a page's head, or main content by what it says of itself."""
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = {w.lower() for k in ("class", "id") for w in WORD.findall(found.get(k, ""))}
    roles = set(found.get("role", "").lower().split())
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    noise = tag in NOISE or bool(words & NOISE_WORDS) or bool(roles & NOISE_ROLES) or hidden
    main = tag in MAIN or bool(roles & MAIN_ROLES) or found.get("itemprop", "").lower() == "articlebody"
    return tag + "".join(f".{w}" for w in sorted(words)), noise and tag not in FRAME, tag in HEADS or bool(words & HEAD_WORDS), main


class Page:
    """The elements of a page with the nodes of the style tree that they belong to, and its blocks of text."""

    def __init__(self, source: str):
        # per element (0: the page): parent, node, tag, what it says of itself: noise, main content
        self.parents, self.nodes, self.tags, self.noise, self.main = [0], [0], [""], [False], [False]
        self.inside: list[list] = [[]]  # the elements (numbers) and blocks (strings) in an element, in page order
        self.blocks: list[tuple[str, int]] = []  # text and element
        self.stack = [0]
        self.pieces: list[str] = []
        at = end = 0
        while m := TOKEN.search(source, at):
            if m.start() > end:
                self.pieces.append(source[end : m.start()])
            at = end = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
                continue
            self.open(tag, m[3] or m[6] or "")
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end = stop.end() if stop else len(source)
                self.close(tag)
        self.pieces.append(source[end:])
        self.flush()

    def open(self, tag: str, attributes: str) -> None:
        label, noise, head, main = described(tag, attributes)
        if tag in INLINE and not noise:
            return
        self.flush()
        if tag in VOID:
            return
        if tag not in INLINE:  # a block ends a paragraph, and items end items of their list
            ends = SELF_CLOSING.get(tag, set()) | {"p"}
            while len(self.stack) > 1 and self.tags[self.stack[-1]] in ends:
                self.stack.pop()
        parent, k = self.stack[-1], len(self.tags)
        self.inside[parent].append(k)
        self.parents.append(parent)
        self.nodes.append(node_name(self.nodes[parent], label))
        self.tags.append(tag)
        self.main.append(main or self.main[parent])
        self.noise.append(noise or (head and not self.main[k]))
        self.inside.append([])
        self.stack.append(k)

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[k]] == tag:
                self.flush()
                del self.stack[k:]
                return
        if tag not in INLINE:
            self.flush()

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        self.pieces.clear()
        if text and self.tags[self.stack[-1]] not in SILENT:
            self.inside[self.stack[-1]].append(text)
            self.blocks.append((text, self.stack[-1]))

    def summaries(self) -> list[tuple[int, int, bool, int, int, int]]:
        """For each node but the root: itself, its parent, whether it is prose by its tag, names of its content and of
        its presentation (the elements below it) on this page, and its code points. The first row is the whole page's."""
        n = len(self.tags)
        content, style, size = [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):  # what is inside an element comes after it
            for x in self.inside[k]:
                content[k] = node_name(content[k], x if isinstance(x, str) else str(content[x]))
                size[k] += len(x) if isinstance(x, str) else size[x]
                if not isinstance(x, str):
                    style[k] = node_name(style[k], f"{self.tags[x]} {style[x]}")
        found: dict[int, list] = {}
        for k in range(1, n):  # elements of one node on a page count together
            if size[k]:
                one = found.setdefault(self.nodes[k], [self.nodes[self.parents[k]], self.tags[k] in PROSE, 0, 0, 0])
                one[2:] = node_name(one[2], str(content[k])), node_name(one[3], str(style[k])), one[4] + size[k]
        return [(0, 0, False, content[0], style[0], size[0]), *((node, *one) for node, one in found.items())]

    def text(self, low: set[int], marks: bool = True) -> str:
        """The page without branches of low importance; then, with marks, without what its own tags, roles and classes
        call noise, and only the article where the page marks one."""
        gone, noise = [False] * len(self.tags), [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            gone[k] = gone[self.parents[k]] or self.nodes[k] in low
            noise[k] = noise[self.parents[k]] or self.noise[k]
        left = [b for b in self.blocks if not gone[b[1]]]
        if marks:
            left = [b for b in left if not noise[b[1]]]
            left = [b for b in left if self.main[b[1]]] or left
        return " ".join(t for t, _ in left)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def site_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            whole, *nodes = Page(source or "").summaries()
            rows += [(host, whole[3], *n) for n in nodes]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "node", "parent", "prose", "content", "style", "size"])


def importances(nodes: DataFrame) -> DataFrame:
    """(host, node, parent, prose, size, content, style, importance) of nodes on MIN_PAGES different pages or more.

    nodes has a row for each different page and node. The entropies of a node's contents and of its presentations over
    the m pages it is on are taken to the base m: 0 when all pages have the same, 1 when each has its own. Importance is
    content times presentation, which counts PLAIN more.
    """
    rows = nodes.groupBy("host", "node", "parent", "prose", "content", "style").agg(F.count("*").alias("k"), F.sum("size").alias("size"))

    def entropy(column: str) -> DataFrame:
        each = rows.groupBy("host", "node", "parent", "prose", column).agg(F.sum("k").alias("k"), F.sum("size").alias("size"))
        per = each.groupBy("host", "node", "parent", "prose").agg(F.sum("k").alias("m"), F.sum("size").alias("size"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("s"))
        return per.where(F.col("m") >= MIN_PAGES).withColumn(column, 1 - F.col("s") / (F.col("m") * F.log(F.col("m").cast("double")))).drop("m", "s")

    both = entropy("content").join(entropy("style").drop("size"), ["host", "node", "parent", "prose"])
    return both.withColumn("importance", F.col("content") * (PLAIN + F.col("style")))


def low_nodes(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, node) of the branches of low importance: of those beside each other, the one with most text in all pages is
    the main one and stays; others go if their importance is below LESS of its own or their contents are mostly the
    same, unless they are prose by their tag. Copies of a page on its host count once."""
    rows = pages.select("host", "html").mapInArrow(site_nodes, "host string, page long, node long, parent long, prose boolean, content long, style long, size long")
    known = scratch.freeze(importances(rows.distinct()), "nodes")
    main = known.groupBy("host", "parent").agg(F.max_by(F.struct("node", "importance"), F.struct("size", "node")).alias("main"))
    beside = known.join(main, ["host", "parent"]).where("node <> main.node AND NOT prose")
    return beside.where((F.col("content") < SAME) | (F.col("importance") < LESS * F.col("main.importance"))).select("host", "node")


def html_extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", column: str = "text", marks: bool = True) -> DataFrame:
    """pages with the main text of each added.

    The DOMs of a host's pages are merged into a style tree, whose nodes are told apart by the tags, classes and ids on
    their path. A node's importance comes from the entropies of its contents and of its presentations over the pages it
    is on. Branches of low importance beside a main branch are removed from each page first: menus, adverts and footers
    look alike on all pages, articles do not, even where the words of both differ. What the tree leaves, since a host
    has too few pages or a branch varies as articles do (reader comments), is then judged by what the page says of its
    own parts (marks=False leaves this out): menus, headers, footers, sidebars, notices, adverts, forms and comments go
    by tag, role or class, and where a page marks an article, only that is kept. Character references are decoded, white
    space in a block becomes one space, and blocks are joined by one space in page order.

    Null or empty html, and pages of noise alone, give an empty text; null urls count as one host. Unclosed, misnested
    and cut-off markup is read as browsers do, roughly; elements may be nested to any depth. Repeated rows are pages of
    their own. An empty table gives an empty result. Other columns pass through, as long as they do not start with two
    underscores; column replaces one of its name.
    """
    scratch = Scratch(pages.sparkSession)
    low = scratch.freeze(low_nodes(scratch, pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))), "low")
    kept = [f for f in pages.schema if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{column}` string"
    names = [f.name for f in kept]

    def run(sets, source: str):
        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [Page(h or "").text(sets(x), marks) for h, x in zip(batch.column(html_col).to_pylist(), batch.column(source).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, column])

        return extract

    hosted = pages.withColumn("__host", host_of(F.col(url_col)))
    if low.count() <= TABLE_ROWS:
        by_host: dict[str, set[int]] = {}
        for r in low.collect():  # at most TABLE_ROWS rows
            by_host.setdefault(r["host"], set()).add(r["node"])
        none: set[int] = set()
        return hosted.mapInArrow(run(lambda host: by_host.get(host, none), "__host"), schema)
    per_host = low.groupBy(F.col("host").alias("__host")).agg(F.collect_set("node").alias("__low"))
    return hosted.join(per_host, "__host", "left").mapInArrow(run(lambda nodes: set(nodes or ()), "__low"), schema)


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
