"""Main text of web pages from the standard library's streaming HTML parser.

One pass over the parser's events gives blocks of text, each with its count of characters,
tags and link characters and the container that holds it.  Blocks under menus, headers,
footers, sidebars, adverts, notices, forms, comment lists and the like, by tag, role, class or
id, can't be content.  Over the others the text-to-tag ratio of each line is smoothed by a
Gaussian and cut at a threshold into content clusters.  As a feature of that ratio, lines outside
a page's own ``article`` and ``main`` elements count no text where those elements hold any.  The
content region is the smallest container that holds all clustered text, an ``article`` at the least,
with the title above it.  The region's blocks are kept whole, so a short paragraph inside it isn't lost.

Defined results: null or empty html, or none but boilerplate, gives an empty text; unclosed and
stray tags are tolerated, an unclosed comment reaches to the page's end; pages of any length or depth are read
whole in linear time; ties between regions go to the first; repeated rows are repeated; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import map_rows

RESULT = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Standard deviation of the smoothing, in lines, and the part of a standard deviation of the
#: smoothed ratios under which a line is outside every cluster.
SIGMA = 1.0
THRESHOLD = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text inside these is never shown or is no running text.
SILENT = frozenset("script style noscript template head title iframe object svg canvas select option textarea datalist audio video map".split())
#: Boilerplate by tag, and by ARIA role.
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert toolbar".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open one of these ends where another of its set, or a block, starts.
CLOSES_P = BLOCKS - {"body", "html"}
ITEMS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
REGIONS = frozenset("article main section div body td".split())
#: Words of class and id, as split at anything but letters, that mark boilerplate wherever they stand,
#: and others that mark it only in a name of no words but these and those of mere layout.
STRONG = frozenset(
    "ads advert adverts advertisement advertising adsense adbox adslot sponsored sponsors promoted outbrain taboola "
    "navbar breadcrumb breadcrumbs pagination sidebar sidebars sidenav footer footnav masthead topbar topnav "
    "cookie cookies gdpr newsletter paywall comments commentlist disqus".split()
)
MARKS = STRONG | frozenset(
    "ad adv banner banners sponsor promo promotion nav navigation menu menus submenu pager toc rail widget widgets "
    "consent notice notices disclaimer alert popup modal overlay subscribe subscription signup comment respond replies discussion reviews "
    "share sharing social related recommended recommendations trending popular teaser teasers login search hidden skip".split()
)
LAYOUT = frozenset(
    "a the and of area article articles bar block body bottom box btn button card cards col column container content desktop div element entry first form full global group "
    "head heading holder home icons id inner item items large last left link links list main mobile module more most news outer page pane panel post posts primary reader row secondary section "
    "site slot small sticky stories story sub tab title to top unit us user view wrap wrapper your".split()
)
#: First words of a class that says what a container has or lacks, and words of a header that is an article's own.
STATES = frozenset("no has with without is not".split())
OWN_HEADERS = frozenset("article post entry content story".split())
_WORD = re.compile(r"[A-Za-z][a-z]*")
_SPACE = re.compile(r"\s+")


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for k, v in attrs:
        if k in ("class", "id") and v:
            if tag in ("body", "html", "article", "main"):
                continue
            for name in v.split():
                words = [w.lower() for w in _WORD.findall(name)]
                if words and words[0] not in STATES:
                    if not STRONG.isdisjoint(words) or not MARKS.isdisjoint(words) and all(w in MARKS or w in LAYOUT for w in words) or "header" in words and len(words) <= 2 and not OWN_HEADERS.intersection(words):
                        return True
        elif k == "role" and v and v.strip().lower() in ROLES:
            return True
        elif k == "hidden" or k == "aria-hidden" and (v or "").lower() == "true":
            return True
        elif k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


class Events(HTMLParser):
    """Blocks of a page: text, tags inside, link characters, containers, and if it is outside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, silent, outside, region
        self.silent = self.outside = self.links = 0
        self.regions: list[tuple[str, int]] = [("", -1)]
        self.region = 0
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = 0
        self.heads: list[int] = []

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # what is left unread is a comment without an end
            self.rawdata = ""
        super().close()

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((text, self.tags, self.link_chars, self.region, self.outside > 0))
            self.parts = []
        self.tags = self.link_chars = 0

    def drop(self, at: int) -> None:
        """Closes all elements from ``at`` of the stack on."""
        for tag, silent, outside, region in reversed(self.stack[at:]):
            if tag in BLOCKS:
                before = len(self.blocks)
                self.flush()
                if tag == "h1" and len(self.blocks) > before and not self.outside:
                    self.heads.append(before)
            self.silent -= silent
            self.outside -= outside
            self.links -= tag == "a"
            self.region = region
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in CLOSES_P:  # a paragraph can't hold a block
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self.drop(i)
                    break
                if self.stack[i][0] in REGIONS or self.stack[i][0] in ITEMS:
                    break
        if tag in ITEMS:
            for i in range(len(self.stack) - 1, -1, -1):
                other = self.stack[i][0]
                if other == tag or other in ITEMS and ITEMS[other] == ITEMS[tag]:
                    self.drop(i)
                    break
                if other in ITEMS[tag]:
                    break
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        names = {t for t, _, _, _ in self.stack} if tag == "header" else ()
        silent = tag in SILENT
        outside = (tag in OUTSIDE and not (tag == "header" and ("article" in names or "main" in names))) or _marked(tag, attrs)
        self.stack.append((tag, silent, outside, self.region))
        self.silent += silent
        self.outside += outside
        self.links += tag == "a"
        if tag in REGIONS:
            self.regions.append((tag, self.region))
            self.region = len(self.regions) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "p" and not any(t == "p" for t, _, _, _ in self.stack[-6:]):
            self.flush()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i][0]
            if open_tag == tag:
                self.drop(i)
                return
            if open_tag in ("body", "article", "main", "table") and tag not in ("body", "html", "article", "main", "table"):
                return  # a stray end tag does not close what holds it

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian average; where the kernel leaves the page its weights are renewed."""
    reach = max(1, math.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    full = np.convolve(x, kernel)[reach : reach + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def clusters(blocks: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """For each block, if it lies in a content cluster of the smoothed text-to-tag ratios."""
    ratio = np.array([0.0 if out else max(0, len(t) - links) / max(1, tags) for t, tags, links, _, out in blocks])
    if not ratio.any():
        return np.zeros(len(blocks), bool)
    level = _smoothed(np.log1p(ratio))
    return (level >= THRESHOLD * level.std()) & (ratio > 0)


def main_text(html: str | None) -> str:
    """The article of one page, its blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    page = Events()
    page.feed(html)
    page.close()
    page.drop(0)
    page.flush()
    regions = page.regions  # a region's container stands before it
    named = [tag in ("article", "main") for tag, _ in regions]
    for r in range(1, len(regions)):
        named[r] = named[r] or named[regions[r][1]]
    own = any(named[b[3]] and not b[4] for b in page.blocks)
    blocks = [(*b[:4], b[4] or own and not named[b[3]]) for b in page.blocks]
    weight = [0] * len(regions)
    for (text, _, links, region, _), good in zip(blocks, clusters(blocks)):
        if good:
            weight[region] += len(text) - links
    below: list[list[int]] = [[] for _ in regions]
    for r in range(len(regions) - 1, 0, -1):
        weight[regions[r][1]] += weight[r]
        below[regions[r][1]].append(r)
    if not weight[0]:
        return "\n".join(b[0] for b in blocks if not b[4]) if own else ""
    pick = 0  # down from the page to the smallest container that still holds all clustered text
    while regions[pick][0] != "article":
        holds = [r for r in below[pick] if weight[r] == weight[0]]
        if not holds:
            break
        pick = holds[-1]
    inside = [False] * len(regions)
    for r in range(len(regions)):
        inside[r] = r == pick or r > 0 and inside[regions[r][1]]
    kept = [i for i, b in enumerate(blocks) if not b[4] and inside[b[3]]]
    if kept and not set(page.heads).intersection(kept):  # a title that stands above the region is the article's
        kept = [i for i in page.heads if i < kept[0]][-1:] + kept
    return "\n".join(blocks[i][0] for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = [main_text(h) for h in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(t) for t in out]}

        return work

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), RESULT, make)
