"""Main text of web pages from streaming parser events.

The standard library's parser reports tags and text; block tags end a line.
Elements that are never the article by HTML's own rules (menus, forms, scripts)
are left out at once. Every other line has a text-to-tag ratio. The ratios are
smoothed by a Gaussian, and lines above a share of their standard deviation
form clusters, which select the regions:

- Article and main elements that hold clustered lines of ``LEAST_LINE``
  characters or more are the regions, each with the headings and clustered
  lines that run on from it without a break.
- Where there is none the page is the region, but for blocks without any clustered line
  whose text is links for the most part.

Parts that a role or a name in class or id marks as something else are left
out of the clusters and the regions, unless they hold a region. If names leave
nothing, they name the layout of the whole page and don't count. A region's
lines are given whole, also the short ones between.

Null and empty pages are empty. Time and memory are linear in a page's length,
however long or deep it is: a comment or tag that never ends is cut off before
parsing, and an article ends menus and forms that were left open around it. Repeated rows are treated
each; ties don't arise. Other columns are kept but for one named like
``text_col``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed values of HTML: elements without content, elements inside a line, and elements that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msup msub mfrac".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe svg button select textarea option head title object canvas audio video dialog menu datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Names in class or id that mark such parts: a whole name, its last part, or its first part before a kind of box.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promoted promotion related respond share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())
MODIFIERS = frozenset("has with without no is not show shows hide hides hidden enable can".split())  # "has-banner" tells of something else
BOXES = frozenset("area bar block body bottom box button buttons container content footer form group header heading holder icons inner item items left link links list module outer panel primary right row secondary section slot thread title top unit widget widgets wrap wrapper".split())
ARTICLE = frozenset(("article", "main"))
WRAPS = frozenset("nav header menu form".split())  # no article stands in these
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
UNNAMED = ARTICLE | {"body", "html"}  # only whole names mark these
BLOCKS = frozenset("div section ul ol dl table tbody tr td center figure details".split())  # what is left out of a page as a block
SIGMA, WIDTH, SHARE = 1.0, 2, 0.5  # of the smoothing, its half width, and the threshold in standard deviations
TAG = re.compile("<[A-Za-z/!?]").search
KERNEL = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-WIDTH, WIDTH + 1)]
LINKS = 0.5  # share of links in a block that is left out
LEAST_LINE = 60  # characters of a line that makes a region, or carries a cluster on beyond it


@lru_cache(4096)
def marked(names: str, whole: bool) -> bool:
    """Whether one of the names of a class or id marks a part that is no article; whole: only whole names."""
    for name in names.lower().split():
        parts = re.split("[_-]+", name.strip("_-"))
        if parts[-1] in NAMES and (len(parts) == 1 or not whole and parts[0] not in MODIFIERS):
            return True
        if not whole and parts[0] in NAMES and (parts[-1] in BOXES or parts[-1].isdigit()):
            return True
    return False


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters in links
    element: int


@dataclass
class Element:
    tag: str
    parent: int
    marked: bool  # itself, by role, attribute or name


class Lines(HTMLParser):
    """Lines of a page that may be content, and its elements in page order."""

    def __init__(self, by_name: bool):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name  # whether marks count
        self.elements = [Element("", -1, False)]
        self.open: list[tuple[str, int]] = []  # tag and element; none is -2 where text is left out, -1 inside
        self.count: Counter[str] = Counter()  # open tags
        self.never, self.left_out = 0, 0  # open elements whose content is never text, and the place of the outermost one
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags, self.links = 0, 0

    def line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append(Line(text, self.tags, self.links, self.inside()))
                self.tags = 0
            self.text.clear()
            self.links = 0

    def inside(self) -> int:
        return self.open[-1][1] if self.open else 0

    def marks(self, tag: str, attrs) -> bool:
        for k, v in attrs if self.by_name else ():
            if k == "hidden" or v and (k in ("class", "id") and marked(v, tag in UNNAMED) or k == "role" and v.lower() in ROLES or k == "aria-hidden" and v == "true"):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if not self.never:
            self.tags += 1
        if tag not in INLINE:
            self.line()
            if self.open and (self.open[-1][0] in INLINE or self.open[-1][0] == "p"):
                self.end_paragraph()
        if tag in VOID:
            return
        if tag in ARTICLE and self.never and self.open[self.left_out][0] in WRAPS:  # one that was never closed, or wraps the page
            self.cut(self.left_out)
        if tag == "body" and self.count["head"]:
            self.cut(next(k for k, x in enumerate(self.open) if x[0] == "head"))
        at = max(self.inside(), -1)
        inline = tag in INLINE
        if tag in NEVER or tag == "header" and not self.count["article"] + self.count["main"] or inline and attrs and self.marks(tag, attrs):
            if not self.never:
                self.left_out = len(self.open)
            self.never += 1
            at = -2
        elif not self.never and not inline:
            self.elements.append(Element(tag, at, bool(attrs) and self.marks(tag, attrs)))
            at = len(self.elements) - 1
        self.open.append((tag, at))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_paragraph(self) -> None:
        """A block ends an open paragraph, and inline elements left open in it."""
        if self.count["p"]:
            for k in range(len(self.open) - 1, -1, -1):
                tag = self.open[k][0]
                if tag == "p":
                    return self.cut(k)
                if tag not in INLINE:
                    return None

    def cut(self, k: int) -> None:
        for tag, at in self.open[k:]:
            self.count[tag] -= 1
            self.never -= at == -2
        del self.open[k:]

    def handle_endtag(self, tag):
        if not self.never:
            self.tags += 1
        if tag not in INLINE:
            self.line()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                return self.cut(k)
            if tag in INLINE and name not in INLINE:
                return  # nothing of this name is open in this block

    def handle_data(self, data):
        if not self.never:
            self.text.append(data)
            if self.count["a"]:
                self.links += len(data.strip())


def clustered(lines: list[Line]) -> list[bool]:
    """Which lines' smoothed text-to-tag ratios reach the threshold."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    near = np.convolve(ratio, KERNEL)[WIDTH : WIDTH + len(ratio)]
    weight = np.convolve(np.ones(len(ratio)), KERNEL)[WIDTH : WIDTH + len(ratio)]
    return list(near / weight >= SHARE * ratio.std())


def inherited(elements: list[Element], own: list) -> list:
    """Of each element: its own value, or else its parent's, from the root down."""
    out = list(own)
    for i in range(1, len(elements)):
        if not out[i]:
            out[i] = out[elements[i].parent]
    return out


def summed(elements: list[Element], lines: list[Line], of) -> list[int]:
    """Of each element, the sum of a number over its lines and those below it."""
    out = [0] * len(elements)
    for k, x in enumerate(lines):
        out[x.element] += of(k, x)
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i].parent] += out[i]
    return out


def closed(html: str) -> str:
    """html without a comment or tag that never ends: the parser would look for
    their ends again and again, and a browser shows nothing of them either."""
    open_comment = html.find("<!--", max(html.rfind("-->"), 0))
    if open_comment >= 0 and html.find("-->", open_comment) < 0:
        html = html[:open_comment]
    rest = html.rfind(">") + 1
    unfinished = TAG(html, rest)
    return html[: unfinished.start()] if unfinished else html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    html = closed(html)
    for by_name in (True, False):
        parser = Lines(by_name)
        parser.feed(html)
        parser.close()
        parser.line()
        elements, lines = parser.elements, parser.lines
        if lines:
            break
    else:
        return ""
    # what holds an article or main element that isn't marked itself is no furniture
    holds = [e.tag in ARTICLE and not e.marked for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] |= holds[i]
    out = inherited(elements, [e.marked and not h for e, h in zip(elements, holds)])
    if all(out[x.element] for x in lines):
        out = [False] * len(elements)
    lines = [x for x in lines if not out[x.element]]
    content = clustered(lines)
    loud = summed(elements, lines, lambda k, x: len(x.text) if content[k] and len(x.text) >= LEAST_LINE else 0)
    region = inherited(elements, [i if e.tag in ARTICLE and not out[i] else 0 for i, e in enumerate(elements)])
    for i in range(1, len(elements)):  # the outermost of nested ones
        region[i] = region[elements[i].parent] or region[i]
    size = summed(elements, lines, lambda k, x: len(x.text))
    links = summed(elements, lines, lambda k, x: x.links)
    outer = {r for r in region if r and loud[r]}
    if outer:
        kept = [region[x.element] in outer for x in lines]
        headed = inherited(elements, [i if e.tag in HEADINGS else 0 for i, e in enumerate(elements)])
        # a cluster that runs on beyond a region belongs to it, with the headings on its way
        for step in (1, -1):
            order = range(len(lines))[::step]
            for k, after in zip(order, order[1:]):
                x = lines[after]
                if kept[k] and not kept[after] and not region[x.element] and 2 * x.links <= len(x.text) and (content[after] and len(x.text) >= LEAST_LINE or headed[x.element]):
                    kept[after] = True
        return " ".join(x.text for x, keep in zip(lines, kept) if keep)
    touched = summed(elements, lines, lambda k, x: int(content[k]))
    quiet = inherited(elements, [i > 0 and e.tag in BLOCKS and not touched[i] and links[i] > LINKS * size[i] for i, e in enumerate(elements)])
    return " ".join(x.text for x in lines if not quiet[x.element])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, with text_col."""
    rest = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, text_col)])

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], text_col])

    source = pages.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(html_col))
    return source.mapInArrow(run, StructType([*rest.schema.fields, StructField(text_col, StringType())]))
