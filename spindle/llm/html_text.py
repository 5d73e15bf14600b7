"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each with the path of its open elements (tags with their class and id words). Per page and path
the blocks are aggregated: characters, sentence punctuation and link characters. Two ratios come from this, characters per
block and punctuation per block (blocks in links count little); both are smoothed over the page's neighbouring blocks, fused by their product, and paths
whose blocks exceed a threshold taken from the page's own spread are content paths. The main text is the element around the
content paths' bulk: short paragraphs, headings, lists and tables inside it belong to the article, whatever their own ratio.

What is never content is taken out before, by kind of element: scripts, forms, navigation, sidebars, and elements whose class
or id names an advert, a notice, reader comments and the like - unless such an element holds the page's main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import table

SMOOTH = (0.25, 0.5, 0.25)  # weights of a block's neighbours
SPREAD = 0.5  # standard deviations of the fused ratio from which a path is content, at most its mean
BULK = 0.8  # share of the content paths' characters that the main element holds
LINKS = 0.6  # share of link characters from which a block inside the main element is a menu

# Element names of HTML, by how they bound text.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
RCDATA = {"title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "output", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
            "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
            "table", "ul"} | HEADINGS
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "div", "section", "article", "body", "html"}

PARTS = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "tr", "tbody", "blockquote", "pre", "figure", "details"}

#: Elements that never hold the main text, and words of classes and ids that say the same.
APART = {"head", "nav", "aside", "footer", "form", "button", "select", "textarea", "title", "menu", "dialog", "object", "svg",
         "canvas", "audio", "video", "datalist", "math", "fieldset", "input", "map", "address"} | RAW
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "toolbar", "topbar",
    "header", "masthead", "footer", "colophon", "copyright", "sidebar", "sidebars", "aside", "rail", "widget", "widgets",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "alert", "disclaimer", "paywall",
    "newsletter", "subscribe", "subscription", "signup", "login", "signin", "register", "search", "share", "sharing", "social",
    "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "related", "recommended",
    "recommendations", "teaser", "teasers", "trending", "tags", "form"}
TITLES = {"article", "entry", "post", "content", "story", "title"}  # whose "header" is the article's own
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog", "toolbar"}

_TOKEN = re.compile(r"<!--(?P<c>.*?)(?:--!?>|\Z)|<!\[CDATA\[(?P<d>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<e>/?)(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…，。、；：！？؟،।]")


class Block:
    """A run of text between block boundaries: its element, its white-space-folded text and its characters in links."""

    __slots__ = ("element", "text", "links")

    def __init__(self, element: int, text: str, links: int):
        self.element, self.text, self.links = element, text, links


class Page:
    """Elements and text blocks of one page, in page order; element 0 is the page. Per element: parent, tag, whether its
    attributes set it apart, and the number of its path (equal steps from the root have equal numbers)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.named, self.path = [-1], [""], [False], [0]
        self.blocks: list[Block] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._open = [0]
        self._frames = [0]  # the open elements that bound blocks
        self._count: dict[str, int] = {}  # open elements by tag
        self._text: list[str] = []
        self._links = 0
        self._block = 0
        self._read(source)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append(Block(self._block, text, min(self._links, len(text))))
        self._text.clear()
        self._links = 0

    def _say(self, raw: str, plain: bool = False) -> None:
        if not raw:
            return
        text = raw if plain else html.unescape(raw)
        if not self._text:
            self._block = self._frames[-1]
        self._text.append(text)
        if self._count.get("a"):
            self._links += len(text.strip())

    def _push(self, tag: str, attributes: str) -> None:
        names: list[str] = []
        role = ""
        hidden = False
        for m in _ATTR.finditer(attributes) if attributes else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += [w.lower() for w in _NAME.findall(html.unescape(value))]
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden":
                hidden = True
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
        up = self._open[-1]
        self.parent.append(up)
        self.tag.append(tag)
        told = NAMES.intersection(names)
        if TITLES.intersection(names):
            told.discard("header")
        self.named.append(hidden or role in ROLES or bool(told))
        e = len(self.tag) - 1
        if tag in INLINE:
            self.path.append(self.path[up])
        else:
            self.path.append(self._paths.setdefault((self.path[up], ".".join([tag, *names])), len(self._paths) + 1))
            self._frames.append(e)
        self._open.append(e)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _close(self, k: int) -> None:
        """Close the open elements from place k on."""
        while len(self._open) > k:
            e = self._open.pop()
            self._count[self.tag[e]] -= 1
            if self._frames[-1] == e:
                self._frames.pop()

    def _place(self, tags: set[str], stop: set[str]) -> int | None:
        """Place of the innermost open element among ``tags``, unless one of ``stop`` lies in between."""
        if any(self._count.get(t) for t in tags):
            for k in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[k]] in tags:
                    return k
                if self.tag[self._open[k]] in stop:
                    break
        return None

    def _close_implied(self, tag: str) -> None:
        if tag in CLOSES_P and self.tag[self._frames[-1]] == "p":
            self._close(self._place({"p"}, set()))
        siblings = SIBLINGS.get(tag)
        while siblings and (k := self._place(siblings, SCOPE)) is not None:
            self._close(k)
        if self._count.get("head") and tag in ("body", "article", "main", "div", "nav", "section", "header"):
            self._close(self._place({"head"}, set()))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            self._say(source[at:m.start()])
            at = m.end()
            if m["d"] is not None:
                self._say(m["d"], plain=True)
            if m["t"] is None:
                continue
            tag = m["t"].lower()
            if tag not in INLINE:
                self._flush()
            elif tag in ("br", "img"):
                self._text.append(" ")
            if m["e"]:
                # a stray end tag of an inline element does not close the block around it
                k = self._place({tag}, set() if tag not in INLINE else CLOSES_P)
                if k is not None:
                    self._close(k)
                continue
            self._close_implied(tag)
            if tag in VOID:
                continue
            self._push(tag, m["a"])
            if (tag in RAW or tag in RCDATA) and not (m["a"] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else n
        self._flush()

    def ancestors(self, e: int) -> Iterator[int]:
        while e >= 0:
            yield e
            e = self.parent[e]


def _apart(page: Page) -> np.ndarray:
    """Whether each element lies in one that is apart. A named one that holds half of the text and a heading, ``article`` or ``main``
    is the page's frame and is not; a header inside an article is its title."""
    n = len(page.tag)
    size, marks = np.zeros(n, np.int64), np.zeros(n, bool)
    plain = np.zeros(n, bool)
    for e in range(1, n):
        tag = page.tag[e]
        plain[e] = plain[page.parent[e]] or tag in APART
        marks[e] |= tag in ("article", "main", "h1")
    for b in page.blocks:
        if not plain[b.element]:
            size[b.element] += len(b.text) - b.links
    for e in range(n - 1, 0, -1):  # children come behind their parents
        size[page.parent[e]] += size[e]
        marks[page.parent[e]] |= marks[e]
    out = np.zeros(n, bool)
    inside = np.zeros(n, bool)  # inside an article or main
    for e in range(1, n):
        up, tag = page.parent[e], page.tag[e]
        inside[e] = inside[up] or tag in ("article", "main")
        frame = tag in ("html", "body", "main", "article") or (marks[e] and 2 * size[e] >= size[0] and tag not in APART)
        header = tag == "header" and not inside[up]
        out[e] = out[up] or tag in APART or header or (page.named[e] and not frame and not (tag == "header" and inside[up])
                                                       and tag not in HEADINGS)
    return out


def _smooth(x: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Weighted mean with the neighbouring blocks of the same page."""
    out, weight = SMOOTH[1] * x, np.full(len(x), SMOOTH[1])
    same = page[1:] == page[:-1]
    out[1:] += np.where(same, SMOOTH[0] * x[:-1], 0)
    weight[1:] += np.where(same, SMOOTH[0], 0)
    out[:-1] += np.where(same, SMOOTH[2] * x[1:], 0)
    weight[:-1] += np.where(same, SMOOTH[2], 0)
    return out / weight


def path_ratios(blocks: pd.DataFrame) -> pd.DataFrame:
    """``blocks`` (page, path, chars, punctuation, links, in page order) with the fused ratio of each block's path and
    whether the path is content."""
    by = ["page", "path"]
    sums = blocks.groupby(by, sort=False)[["chars", "punctuation", "links"]].transform("sum")
    count = blocks.groupby(by, sort=False)["chars"].transform("size")
    free = 1 - sums["links"] / sums["chars"].clip(lower=1)
    chars = sums["chars"] / count * free
    marks = (sums["punctuation"] + 0.1) / count * free
    page = blocks["page"].to_numpy()
    fused = _smooth(chars.to_numpy(), page) * _smooth(marks.to_numpy(), page)
    out = blocks.assign(fused=np.sqrt(fused))
    out["ratio"] = out.groupby(by, sort=False)["fused"].transform("mean")
    stats = out.groupby("page")["fused"]
    limit = np.minimum(SPREAD * stats.transform("std", ddof=0), stats.transform("mean"))
    out["content"] = (out["ratio"] >= limit) & (out["ratio"] > 0)
    return out


def _main_element(page: Page, blocks: list[Block], content: np.ndarray) -> int:
    """The deepest element that holds the bulk of the content paths' characters."""
    size = np.zeros(len(page.tag), np.int64)
    for b, c in zip(blocks, content):
        if c:
            size[b.element] += len(b.text) - b.links
    for e in range(len(size) - 1, 0, -1):
        size[page.parent[e]] += size[e]
    best = max(np.flatnonzero(size >= max(1, BULK * size[0])), default=0)  # those that hold so much lie inside one another
    held = np.zeros(len(page.tag), np.int64)
    for b in blocks:
        held[b.element] += 1
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    while best and (held[best] < 2 or page.tag[best] in PARTS):
        best = page.parent[best]  # one long paragraph or list is not an article of its own
    article = [e for e in page.ancestors(best) if page.tag[e] in ("article", "main")]
    return article[0] if article else best


def main_texts(sources: list[str | None]) -> list[str]:
    """The main text of each page: its blocks in order, joined by line feeds; '' where there is none."""
    pages, kept, rows = [], [], []
    for i, source in enumerate(sources):
        page = Page(source or "")
        apart = _apart(page)
        blocks = [b for b in page.blocks if not apart[b.element]]
        pages.append(page)
        kept.append(blocks)
        rows += [(i, page.path[b.element], len(b.text), len(_PUNCTUATION.findall(b.text)), b.links) for b in blocks]
    if not rows:
        return [""] * len(sources)
    found = path_ratios(pd.DataFrame(rows, columns=["page", "path", "chars", "punctuation", "links"]))
    content = found["content"].to_numpy()
    ends = np.cumsum([len(b) for b in kept])
    out = []
    for page, blocks, e in zip(pages, kept, ends):
        mine = content[e - len(blocks):e]
        main = _main_element(page, blocks, mine)
        inside = np.zeros(len(page.tag), bool)
        inside[main] = True
        for k in range(main + 1, len(page.tag)):
            inside[k] = inside[page.parent[k]]
        text = [b.text for b, c in zip(blocks, mine) if inside[b.element] and (c or b.links < LINKS * len(b.text))]
        out.append("\n".join(text))
    return out


def extract(pages: DataFrame, source: str = "html", out: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of ``source`` and its code points.

    NULL and empty pages and pages without text give ''. Repeated rows are read one by one; an empty table stays empty; other columns stay.
    ``ValueError`` if one of the new columns exists.
    """
    taken = {out, n_chars} & set(pages.columns)
    if taken:
        raise ValueError(f"the input already has columns {sorted(taken)}")

    def run(batches):
        for b in batches:
            col = b.column(source)
            texts: list[str] = []
            for a in range(0, b.num_rows, 256):  # a small table of blocks at a time
                texts += main_texts(col.slice(a, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=[*b.schema.names, out, n_chars])

    return pages.mapInArrow(run, pages.withColumns({out: F.lit(None).cast("string"), n_chars: F.lit(None).cast("long")}).schema)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
