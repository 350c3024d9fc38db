"""Main text of web pages: flat text blocks, judged by a decision tree from their words, links, neighbours and markup.

A page is cut into a flat list of blocks where block elements begin or end. A block has its words, its link density
(the share of words inside links), both for the block before and the one after, what kind of element it is, and what
the elements around it say about themselves: the nearest one whose tag, class, id or role names content or
furniture (navigation, footer, advert, form, notice), whether one of them holds reader comments, and how many
blocks, and long ones without links, of the page say the same. A decision tree, grown on the blocks of the labelled pages in training.py, keeps
or drops each block. Scripts, styles, comments of the markup and the head never give blocks.

Decoding follows the rules of HTML where a page is broken: elements may be left open, an unclosed comment or script
runs to the end, a tag cut off by the end is no text, and names of character references may lack their semicolon.

Odd rows. A null or empty page, or one without an article, has an empty text. Nothing is dropped for its length, and
equal rows give equal results. Keys are not looked at, so null and repeated ones pass. The columns main_text and n_blocks of the
table are replaced, all others stay. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import appended, passes, with_fields

#: A tag with its attributes, or markup that is no tag. Quotes count after an equals sign only, as in browsers.
MARKUP = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|/>"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z))",
    re.S,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.S)

# -- fixed values: elements by what they do -------------------------------------------------------------------
#: Text runs on through these; all other elements end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
#: White space stands for them.
BREAKS = frozenset(["br", "wbr", "img"])
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Nothing within them is text of the page.
SILENT = frozenset("head script style textarea title iframe noembed noframes noscript template svg math select option object canvas audio video button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What elements say by their tag or role.
FURNITURE_TAGS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "header": "header", "dialog": "notice"}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "main": "content", "article": "content"}
#: What class names and ids say, by their words.
SAYS = {
    "menu": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar tabs toc skip sitemap",
    "footer": "footer foot copyright colophon legal imprint credits",
    "header": "header masthead topbar banner logo branding tagline",
    "aside": "sidebar aside widget widgets related recommended recommendations trending popular teaser teasers promo promos promotion rail social share sharing follow newsletter",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors commercial outbrain taboola adbox adslot dfp",
    "form": "form login signup signin register subscribe subscription search searchbox contact poll survey",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay alert alerts disclaimer paywall notification toast hidden",
    "comment": "comment comments commentlist commentary disqus discussion replies reply respond responses feedback guestbook reviews",
    "content": "article content entry post story body text main maincontent hentry prose articlebody storybody postbody",
}
WORDS = {w: kind for kind, words in SAYS.items() for w in words.split()}
#: Words that make a class name say nothing: it describes a layout rather than what is in the element.
LAYOUT = frozenset("has no with without open closed enabled disabled count layout".split())
KINDS = ["none", "content", "menu", "footer", "header", "aside", "advert", "form", "notice"]
# -------------------------------------------------------------------------------------------------------------

FEATURES = [
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "heading", "item", "comment", "siblings", "long_siblings", "long_neighbours", *(f"in_{k}" for k in KINDS),
]
#: A block of so many words is long.
LONG = 15


@lru_cache(maxsize=65_536)
def said(names: str) -> str:
    """What a class attribute or an id says, "" for nothing: furniture before content, but an article's header is content."""
    out = ""
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        kinds = [WORDS[w] for w in words if w in WORDS] if LAYOUT.isdisjoint(words) else []
        other = [k for k in kinds if k != "content" and not (k == "header" and "content" in kinds)]
        if other:
            return next((k for k in reversed(other) if k != "header"), "header")
        out = out or (kinds and "content" or "")
    return out


@dataclass(slots=True)
class Element:
    tag: str
    #: Of the nearest element around that says something, this one included.
    kind: str
    comment: bool
    #: Whether its text is none of the page's.
    silent: bool
    #: Whether it stands inside of content.
    inside: bool


@dataclass(slots=True)
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    element: Element | None = None
    text: str = ""
    words: int = 0
    #: 1 where a labelled page says that the block belongs to the article.
    label: int = 0


def element_of(tag: str, attributes: str, around: Element) -> Element:
    own = FURNITURE_TAGS.get(tag, "content" if tag in ("article", "main") else "")
    if attributes and tag not in ("html", "body"):
        says = [own]
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                says.append(said(unescape(value)))
            elif name == "role":
                says.append(ROLES.get(value.strip().lower(), ""))
            elif (name == "style" and HIDDEN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
                says.append("notice")
        if "hidden" in ATTRIBUTE.sub(" ", attributes).lower().split():
            says.append("notice")
        # of what an element says, comments win, then the last that isn't content
        other = [k for k in says if k not in ("", "content")]
        own = "comment" if "comment" in says else other[-1] if other else "content" if "content" in says else ""
    if own == "header" and around.inside:
        own = ""  # the header of an article
    if own == "comment":
        return Element(tag, around.kind, True, around.silent or tag in SILENT, around.inside)
    return Element(tag, own or around.kind, around.comment, around.silent or tag in SILENT, around.inside or own == "content")


#: No page nests so deep; of more open elements the outer ones are closed.
OPEN = 2000
#: A new one of these ends an open one of the same row or list, up to the elements that hold them.
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset(["ul", "ol", "menu", "dl", "table"])


class Reader:
    """Reads a page's markup and gathers its blocks, those without text left out."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open = [Element("", "none", False, False, False)]
        self.block, self.links = Block(), 0

    def end_block(self) -> None:
        if self.block.parts:
            text = " ".join("".join(self.block.parts).split())
            if text:
                self.block.text, self.block.words = text, text.count(" ") + 1
                self.blocks.append(self.block)
            self.block = Block()

    def hear(self, piece: str) -> None:
        if not piece or self.open[-1].silent:
            return
        piece = unescape(piece) if "&" in piece else piece
        if self.block.element is None and not piece.isspace():
            self.block.element = next(e for e in reversed(self.open) if e.tag not in INLINE)
        self.block.parts.append(piece)
        if self.links:
            self.block.linked += len(piece.split())

    def close_from(self, k: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.open[k:])
        del self.open[k:]

    def close(self, tags: tuple[str, ...], within: frozenset[str] | None) -> None:
        """Closes the last open element of these tags, unless one of `within` (None: any block element) stands before it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                return self.close_from(k)
            if tag in within if within is not None else tag not in INLINE:
                return None
        return None

    def read(self, page: str) -> list[Block]:
        at = 0
        while at < len(page):
            m = MARKUP.search(page, at)
            self.hear(page[at : m.start() if m else len(page)])
            if m is None or (m[2] is not None and m[0][-1] != ">"):
                break  # the rest is text, or a tag that the end of the page cuts off
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in INLINE:
                self.end_block()
            elif tag in BREAKS:
                self.hear(" ")
            if m[1]:
                self.close((tag,), None if tag in INLINE else frozenset())
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID:
                self.start(tag, m[3])
        self.end_block()
        return self.blocks

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self.close(("p",), None)
        if tag in PEERS:
            self.close(PEERS[tag], HOLDERS | {"tr"} if tag in ("td", "th") else HOLDERS)
        if tag == "a":
            self.close(("a",), None)
            self.links += 1
        if tag == "body":  # the head may have been left open
            self.close(("head",), frozenset())
        self.open.append(element_of(tag, attributes, self.open[-1]))
        if len(self.open) > OPEN:
            outer = self.open[1 : OPEN // 2]
            self.links -= sum(e.tag == "a" for e in outer)
            del self.open[1 : OPEN // 2]


def text_blocks(page: str) -> list[Block]:
    return Reader().read(page)


def features(blocks: list[Block]) -> np.ndarray:
    """One row a block, in the order of FEATURES."""
    n = len(blocks)
    x = np.zeros((n + 2, len(FEATURES)))  # a row of zeros before and after
    words = np.array([b.words for b in blocks], float)
    x[1:-1, 0] = words
    x[1:-1, 1] = np.minimum(1.0, np.array([b.linked for b in blocks], float) / np.maximum(words, 1))
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, :2], x[2:, :2]
    x = x[1:-1]
    x[:, 11] = ((x[:, 2] >= LONG) & (x[:, 3] < 0.5)).astype(int) + ((x[:, 4] >= LONG) & (x[:, 5] < 0.5))
    together: dict[tuple[str, bool], list[int]] = {}
    for i, b in enumerate(blocks):
        e = b.element
        x[i, 6], x[i, 7], x[i, 8] = e.tag in HEADINGS, e.tag in ("li", "dt", "dd"), e.comment
        x[i, 12 + KINDS.index(e.kind)] = 1
        together.setdefault((e.kind, e.comment), []).append(i)
    for same in together.values():  # of blocks that say the same: how many, and how many long ones without links
        x[same, 9] = len(same)
        x[same, 10] = np.sum((x[same, 0] >= LONG) & (x[same, 1] < 0.5))
    return x


@dataclass(slots=True)
class Tree:
    """Node k asks whether feature[k] is at most cut[k]: yes left[k], no right[k]. Leaves have feature -1 and their share of kept blocks."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        """The node for these rows: split where Gini's impurity falls most, ties to the first feature and the lowest cut."""
        k = len(self.feature)
        for column, value in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.share, float(y.mean()))):
            column.append(value)
        if depth == 0 or y.min() == y.max():
            return k
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, kept = x[order, f], np.cumsum(y[order])
            i = np.flatnonzero((v[1:] > v[:-1]) & (np.arange(1, len(v)) >= least) & (np.arange(1, len(v)) <= len(v) - least))
            if not len(i):
                continue
            a, b = i + 1, len(v) - i - 1
            p, q = kept[i] / a, (kept[-1] - kept[i]) / b
            gain = whole - (a * p * (1 - p) + b * q * (1 - q)) / len(v)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-12:
                best = (float(gain[j]), f, float((v[i[j]] + v[i[j] + 1]) / 2))
        if best[1] >= 0:
            self.feature[k], self.cut[k] = best[1], best[2]
            low = x[:, best[1]] <= best[2]
            self.left[k] = self.grow(x[low], y[low], depth - 1, least)
            self.right[k] = self.grow(x[~low], y[~low], depth - 1, least)
        return k

    def judge(self, x: np.ndarray) -> np.ndarray:
        """The share of kept blocks in each row's leaf."""
        feature, cut, left, right = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), int)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] <= cut[at], left[at], right[at])
        return np.array(self.share)[node]


#: Depth of the tree and the fewest labelled blocks in a leaf.
DEPTH, LEAST = 12, 2


def fit(pages: Iterable[str]) -> Tree:
    """A tree from labelled pages: an element with the attribute data-keep holds what is to be kept (see training.py)."""
    xs, ys = [], []
    for page in pages:
        marked = text_blocks(page.replace(KEEP, MARK))
        for b in marked:
            b.label = int(MARK in b.text)
            b.text = b.text.replace(MARK, "").strip()
            b.words = len(b.text.split())
        xs.append(features(marked))
        ys.append([b.label for b in marked])
    tree = Tree()
    tree.grow(np.concatenate(xs), np.concatenate(ys).astype(float), DEPTH, LEAST)
    return tree


#: In labelled pages, at the start of each block that belongs to the article.
KEEP = "{keep}"
MARK = "⁠"


@lru_cache(maxsize=1)
def standard() -> Tree:
    from . import training

    return fit(training.pages())


def kept_blocks(page: str, tree: Tree) -> tuple[list[str], int]:
    """Texts of the blocks that are kept, and how many there were."""
    blocks = text_blocks(page)
    if not blocks:
        return [], 0
    keep = tree.judge(features(blocks)) >= 0.5
    return [b.text for b, k in zip(blocks, keep) if k], len(blocks)


def extract(pages: DataFrame, html: str = "html", tree: Tree | None = None) -> DataFrame:
    """pages without their html, with main_text (kept blocks joined by an empty line) and n_blocks."""
    tree = tree or standard()
    rest = pages.drop("main_text", "n_blocks") if html.lower() not in ("main_text", "n_blocks") else pages
    schema = with_fields(rest.drop(html), main_text=T.StringType(), n_blocks=T.IntegerType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(html)).to_pylist()
            for a, b in passes(texts):
                found = [kept_blocks(t or "", tree) for t in texts[a:b]]
                yield appended(batch.slice(a, b - a), arrow, main_text=pa.array(["\n\n".join(k) for k, _ in found], pa.string()), n_blocks=pa.array([n for _, n in found], pa.int32()))

    return rest.mapInArrow(run, schema)
