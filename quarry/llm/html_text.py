"""Operator 6: main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events; blocks of text between block-level tags are the lines. A line's
ratio is its characters over its tags (1 at least). Text inside menus, sidebars, footers, form controls and the like,
and inside elements whose role, or a class or id by its whole or leading name, says adverts, notices or comments, counts
nothing in it; text inside <article> and <main> counts twice. Names alone can mislead: a named element (or a form, or a
list of links) counts as any other if it holds most of the page's text, or most of what <article> and <main> hold.

Ratios are smoothed with a Gaussian kernel. The threshold is the smoothed ratios' standard deviation, or their mean if
that is less, and LEAST_RATIO at least. Lines that reach it are content. The content region is the element whose lines
gain most: a line's characters times its ratio's distance from the threshold, in thresholds, between -1 and 1. It is
widened to the container around it, and inside an <article> or <main> to all of that. The text is made of the content
lines of the region and of its lines below the threshold of which something counts: short paragraphs, headings, items.

White space within a block becomes one space, blocks are joined by a newline, empty blocks give no line. Null and empty
pages, and pages without text, give an empty text. Broken markup is read as far as it goes; time and memory grow with a page's
length, however deep its elements lie. Repeated rows are read each for itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, table

SIGMA, LEAST_RATIO, REGION_WEIGHT = 1.0, 0.2, 2
#: The share of the page's text that clears a named element, in general and for readers' comments; a list of links.
CLEARS, CLEARS_COMMENTS, LINK_SHARE, LINK_LINES = 0.5, 0.9, 0.8, 3
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

# Element names of HTML and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center details div form html main section td".split())
CLOSED_BY_NEXT = frozenset("p li h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("audio canvas datalist embed head iframe input noscript object script select style svg template textarea title video".split())
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer label legend menu nav".split())
REGIONS = frozenset({"article", "main"})
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
FURNITURE = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-share captcha consent cookie cookies copyright disclaimer footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar tooltip widget widgets warning".split()
)
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

PLAIN, NAMED, COMMENT, FIXED, HIDDEN = range(5)
#: A start tag that is whole before the next "<", and where a tag begins that the page's end cuts off.
WHOLE_TAG = re.compile(r"""<[A-Za-z][^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*>""")
CUT_TAG = re.compile(r"<[A-Za-z/!?]")


def is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(attrs: list[tuple[str, str | None]]) -> int:
    """COMMENT, NAMED or PLAIN by an element's role, classes and id."""
    found = PLAIN
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            for token in value.split():
                leading = next(filter(None, re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", token)), "")
                words = {token.lower(), leading.lower()}
                if words & COMMENTS:
                    return COMMENT
                if words & FURNITURE:
                    found = NAMED
        elif name == "role" and value.lower() in FURNITURE_ROLES:
            found = NAMED
    return found


class Page(HTMLParser):
    """Collects elements, numbered from 1 in page order (0 is the page), and lines of text parts with their elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.kind, self.in_region = [""], [0], [PLAIN], [False]
        self.open: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of each name, where in open it is
        self.blocks: list[int] = []  # where in open the blocks are
        self.links = 0
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # parts, tags, element
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = 0
        self.endless: set[str] = set()  # kinds of markup of which one has no end: later ones have none either

    def read(self, html: str) -> None:
        end = html.rfind(">") + 1  # no tag ends after it
        self.feed(html[:end])
        self.close()
        if not self.cdata_elem:
            cut = CUT_TAG.search(html, end)
            self.handle_data(unescape(html[end : cut.start() if cut else len(html)]))
        self.flush()

    def top(self) -> int:
        return self.open[-1] if self.open else 0

    def flush(self) -> None:
        parts, self.parts = self.parts, []
        if any(text.strip() for text, _, _ in parts):
            self.lines.append((parts, max(1, self.tags), self.top()))
            self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append((" ", self.top(), False))
            return
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSED_BY_NEXT and self.blocks and self.tag[self.open[self.blocks[-1]]] == tag:
                self.close_from(self.blocks[-1])  # a paragraph, item or heading that is still open ends here
        above = self.top()
        if self.kind[above] == HIDDEN or tag in UNSEEN or tag not in ("html", "body") and attrs and is_hidden(attrs):
            kind = HIDDEN
        elif tag in FURNITURE_TAGS or tag == "header" and not self.in_region[above]:
            kind = FIXED
        elif tag in ("html", "body"):
            kind = PLAIN
        else:
            kind = (named(attrs) if attrs else PLAIN) or (NAMED if tag == "form" else PLAIN)
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.places[tag].append(len(self.open))
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(above)
        self.kind.append(kind)
        self.in_region.append(self.in_region[above] or tag in REGIONS)
        self.links += tag == "a"

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.places[tag].pop()
            self.links -= tag == "a"
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.flush()
        places = self.places.get(tag)
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):  # an inline element's end doesn't end blocks
            self.close_from(places[-1])

    def once(self, kind: str, found: int) -> int:
        if found < 0:
            self.endless.add(kind)
        return found

    def parse_starttag(self, i):
        if "tag" in self.endless and not WHOLE_TAG.match(self.rawdata, i):  # an open quote would be looked for to the end
            return -1
        return self.once("tag", super().parse_starttag(i))

    def parse_comment(self, i, report=1):
        return -1 if "comment" in self.endless else self.once("comment", super().parse_comment(i, report))

    def parse_marked_section(self, i, report=1):
        return -1 if "section" in self.endless else self.once("section", super().parse_marked_section(i, report))

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a declaration that the parser can't read: its "<" is text
            self.handle_data("<")
            return i + 1

    def handle_data(self, data):
        if self.kind[self.top()] != HIDDEN:
            self.parts.append((data, self.top(), self.links > 0))

    def summed(self, own: dict[int, float]) -> list[float]:
        """Per element what it and all inside it have."""
        out = [0] * len(self.tag)
        for number in range(len(out) - 1, -1, -1):
            out[number] += own.get(number, 0)
            if number:
                out[self.parent[number]] += out[number]
        return out

    def weights(self) -> list[int]:
        """Per element how its text counts: 0 in furniture, REGION_WEIGHT in articles, else 1."""
        sizes, in_links, in_regions, lines = (defaultdict(int) for _ in range(4))
        fixed = [False] * len(self.tag)
        for number in range(1, len(fixed)):
            fixed[number] = fixed[self.parent[number]] or self.kind[number] == FIXED
        for parts, _, element in self.lines:
            lines[element] += 1
            for text, number, link in parts:
                if not fixed[number]:
                    size = len("".join(text.split()))
                    sizes[number] += size
                    in_links[number] += size if link else 0
                    in_regions[number] += size if self.in_region[number] else 0
        sizes, in_links, in_regions, lines = map(self.summed, (sizes, in_links, in_regions, lines))
        held = in_regions if any(self.in_region) else sizes
        out = [1] * len(self.tag)
        for number in range(1, len(out)):
            kind = self.kind[number]
            if kind == PLAIN and self.tag[number] in BLOCKS and lines[number] >= LINK_LINES and in_links[number] > LINK_SHARE * sizes[number]:
                kind = NAMED
            cleared = kind == PLAIN or kind in (NAMED, COMMENT) and held[number] > (CLEARS if kind == NAMED else CLEARS_COMMENTS) * held[0]
            out[number] = out[self.parent[number]] if cleared else 0
            if out[number] and self.in_region[number]:
                out[number] = REGION_WEIGHT
        return out

    def container(self, number: int) -> int:
        """The content region around an element: the outermost article, else main, else the nearest container."""
        found, up = {}, number
        while up:
            found[self.tag[up]] = up
            if self.tag[up] in CONTAINERS:
                found.setdefault("", up)
            up = self.parent[up]
        return found.get("article") or found.get("main") or found.get("", 0)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian means; a ratio of 0, where nothing counts, is lent nothing by its neighbours."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    n, out = len(ratios), []
    for i in range(n):
        low, high = max(0, i - reach), min(n, i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, ratios[low:high])) / sum(weights) if ratios[i] else 0.0)
    return out


def threshold_of(ratios: list[float]) -> float:
    mean = sum(ratios) / len(ratios)
    return max(LEAST_RATIO, min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))))


def main_text(html: str | None) -> str:
    page = Page()
    page.read(html or "")
    if not page.lines:
        return ""
    weights = page.weights()
    lines, ratios = [], []  # lines: text, whether some of it counts, element
    for parts, tags, element in page.lines:
        counted = [(text, weights[number]) for text, number, _ in parts if weights[number]]
        text = " ".join("".join(text for text, _ in counted).split())
        ratios.append(len(text) * max((w for x, w in counted if x.strip()), default=0) / tags)
        lines.append((text or " ".join("".join(x for x, _, _ in parts).split()), bool(text), element))
    ratios = smoothed(ratios)
    threshold = threshold_of(ratios)
    if max(ratios) < threshold:
        return ""
    gains = defaultdict(float)
    for (text, _, element), ratio in zip(lines, ratios):
        gains[element] += len(text) * max(-1.0, min(1.0, ratio / threshold - 1))
    gained = page.summed(gains)
    region = page.container(max(range(len(gained)), key=lambda number: (gained[number], -number)))
    inside = [number == region for number in range(len(page.tag))]
    for number in range(region + 1, len(inside)):
        inside[number] = inside[page.parent[number]]
    return "\n".join(text for (text, counts, element), ratio in zip(lines, ratios) if inside[element] and (counts or ratio >= threshold))


def extract_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield batch(PAGES, page_id=b.column(0), url=b.column(1), text=texts, n_chars=[len(t) for t in texts])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
