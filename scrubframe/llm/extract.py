"""Main text of web pages: flat text blocks, shallow features of a block and its neighbours, and a small decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scrubframe.llm.labelled import LABELLED_PAGES, LAYOUTS, NAMED_LAYOUTS, TEXTS, fill, layout_pages, wrapped_pages

#: Comments and declarations, closing tags without a name, or a tag with its attributes. Only a value that starts with a quote
#: is a quoted one, so quotes inside other values mean nothing; every part is possessive, so any source is read in linear time.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:>|[^A-Za-z>][^>]*+(?:>|\Z))
    |<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)""",
    re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+))?+)?+""")
#: Elements whose content is read as text up to their closing tag, or to the end of the page.
SWALLOW = frozenset("script style textarea title xmp noframes noembed".split())
#: Elements whose content is no text of the page; without a closing tag they hold nothing.
RAW = frozenset("noscript template iframe svg math canvas object video audio select head".split())
#: Of these, those that end at the next block of the page when they are not closed before it.
BROKEN_BY_BLOCKS = frozenset(("svg", "math", "select"))
BLOCK_START = r"<(?:p|div|h[1-6]|ul|ol|li|dl|table|article|section|main|aside|footer|header|nav|blockquote|pre|body)(?=[\s/>])"
#: Elements that run inside a line of text; any other element ends the block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
#: Elements whose closing tag may be left out: what opens next ends them, up to the container named.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")),
           "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
SIDE = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "button": "form",
        "fieldset": "form"}
MAIN = frozenset(("article", "main"))
#: Words of class, id, role and label that mark an element as something beside the article.
HINTS = {"menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs", "header": "header masthead banner topbar",
         "footer": "footer copyright colophon contentinfo", "side": "sidebar aside related recommended widget complementary share social tags trending",
         "notice": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe signup dialog",
         "advert": "ad ads advert adverts advertisement sponsored sponsor promo promoted banner-ad adsense",
         "form": "form login search", "comments": "comment comments discussion disqus replies respond reader-comments"}
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
#: A name with one of these words tells about the state or layout of an element that holds more than what it names.
STATES = frozenset("has no not with without is js free open opened closed enabled disabled on off hide hidden show layout wrap wrapper".split())
#: Names on these elements describe the page as a whole.
WHOLE = frozenset(("html", "body", "main"))
FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "place", "heading", "paragraph")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    in_main: bool
    beside: bool
    heading: bool
    paragraph: bool


def hint(names: str) -> str | None:
    """What the names of an element mark it as: a name counts if it is a word of the list or a compound that starts or ends with one."""
    for name in names.lower().split():
        parts = [w for w in re.split("[-_]+", name) if w]
        found = HINT_OF.get(name)
        if found is None and parts and not STATES.intersection(parts):
            found = HINT_OF.get(parts[-1]) or HINT_OF.get(parts[0])
        if found is not None:
            return found
    return None


@dataclass
class _Open:
    """An open element with what it and the elements around it say."""

    name: str
    is_main: bool = False
    main: bool = False
    side: bool = False
    header: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    names: Counter = field(default_factory=Counter)
    link_depth: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.link_depth > 0))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                linked = len(" ".join(t for t, in_link in self.parts if in_link).split())
                at = self.stack[-1]
                self.blocks.append(Block(text, len(text.split()), linked, at.main, at.side or (at.header and not at.main),
                                         re.fullmatch("h[1-6]", at.name) is not None, at.name == "p"))
            self.parts = []

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on, and a link that was opened in one of them."""
        self.names.subtract(o.name for o in self.stack[depth:])
        del self.stack[depth:]
        if self.link_depth > depth:
            self.link_depth = 0

    def open(self, name: str, source: str) -> None:
        attributes = {m.group(1).lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(source)} if source else {}
        if name in INLINE:
            if name == "a":
                self.link_depth = len(self.stack) if "href" in attributes else 0
            elif name == "br":
                self.text(" ")
            return
        self.end_block()
        if self.stack[-1].name == "p" or (re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.stack[-1].name)):
            self.cut(len(self.stack) - 1)
        if name in VOID:
            return
        ends, within = IMPLIED.get(name, ((), ()))
        for k in range(len(self.stack) - 1, 0, -1) if any(self.names[e] for e in ends) else ():
            if self.stack[k].name in ends:
                self.cut(k)
                break
            if self.stack[k].name in within or self.stack[k].is_main:
                break
        is_main = name in MAIN or "main" in attributes.get("role", "").lower().split()
        kind = SIDE.get(name)
        if kind is None and name not in WHOLE and not (is_main and name not in MAIN):
            kind = hint(html.unescape(" ".join(attributes.get(a, "") for a in ("class", "id", "role", "aria-label"))))
        around, header = self.stack[-1], kind == "header"
        main = around.main or is_main
        self.names[name] += 1
        self.stack.append(_Open(name, is_main, main, around.side or (kind is not None and not header), around.header or header))

    def close(self, name: str) -> None:
        if name == "a":
            self.link_depth = 0
        if name in INLINE:
            return
        self.end_block()
        if not self.names[name] and not re.fullmatch("h[1-6]", name):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            at = self.stack[k]
            if at.name == name or (re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", at.name)):
                self.cut(k)
                return
            if (at.is_main and name not in WHOLE) or (at.name in TABLE and name not in TABLE) or (name == "p") or at.name in IMPLIED.get(name, ((), ()))[1]:
                return


def blocks_of(source: str) -> list[Block]:
    """Flat text blocks of a page in page order. Tags may be unclosed or cut off; a link never reaches past its block's container."""
    page, at, n, unclosed = _Page(), 0, len(source), set()
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            page.text(source[at:])
            break
        page.text(source[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                page.text(m.group()[9:].removesuffix("]]>"))
            continue
        name = m.group(2).lower()
        if m.group(1):
            page.close(name)
        elif name in SWALLOW:
            if name != "title":
                page.end_block()
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
        elif name in RAW:
            if name != "head":
                page.end_block()
            if name in unclosed or (name in ("svg", "math") and m.group().endswith("/>")):
                continue
            start = "|(?=<body[\\s/>])" if name == "head" else f"|(?={BLOCK_START})" if name in BROKEN_BY_BLOCKS else ""
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>{start}", re.I).search(source, at)
            if end is None:
                unclosed.add(name)
            else:
                at = end.end()
        else:
            page.open(name, m.group(3))
    page.end_block()
    return page.blocks


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """Features of each block: its own and its neighbours' word counts (20 at most) and link densities, and where it stands.

    Its place is 0 in a part named as something beside the article, or outside of the article element of a page that has
    one; 2 inside of an article element; 1 where nothing tells.
    """
    has_main = any(b.in_main for b in blocks)
    own = [(float(min(b.words, 20)), b.link_words / b.words) for b in blocks]
    none = (0.0, 0.0)
    place = [0.0 if b.beside or (has_main and not b.in_main) else 2.0 if b.in_main else 1.0 for b in blocks]
    return [(*own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), place[k], float(b.heading), float(b.paragraph))
            for k, b in enumerate(blocks)]


@dataclass(frozen=True)
class Tree:
    """A fitted tree as plain nodes: (feature, threshold, left, right), or (-1, label, 0, 0) for a leaf."""

    nodes: tuple[tuple[int, float, int, int], ...]

    def says(self, x: tuple[float, ...]) -> bool:
        k = 0
        while self.nodes[k][0] >= 0:
            f, threshold, left, right = self.nodes[k]
            k = left if x[f] <= threshold else right
        return self.nodes[k][1] > 0.5


def labelled_rows() -> list[tuple[tuple[float, ...], float]]:
    """The small labelled table: blocks of hand-written pages and of the layouts, marked as article or not."""
    named = [fill(layout, turn, False) for layout in NAMED_LAYOUTS for turn in range(len(TEXTS))]
    rows = []
    for source, article in [*LABELLED_PAGES, *layout_pages(LAYOUTS), *named]:
        blocks = blocks_of(source)
        wanted = [" ".join(t.split()) for t in article]
        rows += [(x, float(b.text in wanted)) for b, x in zip(blocks, features(blocks), strict=True)]
    for source, kept in wrapped_pages():
        rows += [(x, float(kept)) for x in features(blocks_of(source))]
    return rows


def train(spark: SparkSession, rows: list[tuple[tuple[float, ...], float]] | None = None, depth: int = 12) -> Tree:
    """Fit the decision tree on the labelled table (fixed and small, so one task holds it)."""
    rows = labelled_rows() if rows is None else rows
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    table = spark.createDataFrame([(label, Vectors.dense(x)) for x, label in rows], schema)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=1).fit(table.coalesce(1))
    nodes: list[tuple[int, float, int, int]] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append((-1, node.prediction(), 0, 0))
        if node.numDescendants():
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right)
        return at

    walk(model._call_java("rootNode"))
    return Tree(tuple(nodes))


def main_text(source: str, tree: Tree) -> str:
    blocks = blocks_of(source)
    return "\n".join(b.text for b, x in zip(blocks, features(blocks), strict=True) if tree.says(x))


def extract(pages: DataFrame, tree: Tree, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every page from its whole source: the kept columns, ``text`` and ``n_chars``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line break.
    Null and empty sources give an empty text; every row gives one row, so repeated rows and null ids are fine; an empty
    table gives an empty table. A long page is read in one pass, in time linear in its length. Other columns are left out,
    also those called text or n_chars. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t or "", tree) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*keep, "text", "n_chars"])

    rows = pages.select(*keep, "html")
    schema = T.StructType([*rows.drop("html").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
