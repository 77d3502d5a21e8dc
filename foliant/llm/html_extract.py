"""Main text of web pages by text-to-tag ratios over parser events."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines on either side that smooth a ratio, and the width of the Gaussian.
RADIUS, SIGMA = 2, 1.0
#: Lines are content where the smoothed ratio exceeds this many standard deviations.
LAMBDA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
#: Parts of a text; the region of a page is never one of them alone.
TEXTUAL = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 hgroup header blockquote pre caption figcaption figure address summary".split())
#: Inside these nothing is main text.
OUTSIDE = frozenset(
    "head nav footer aside script style noscript template button select option textarea iframe svg canvas "
    "object audio video map menu dialog title fieldset".split()
)
#: A named part or a form that holds more than this share of the content cluster is a wrapper and no part.
WRAPPER = 0.5
#: Words in class, id or role that name such a part.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay toast sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar "
    "footer copyright share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search widget widgets pagination pager masthead contentinfo complementary".split()
)
#: Words that name reader comments; an article in them is a comment.
READERS = frozenset("comment comments commentlist respond disqus replies reply responses discussion reviews".split())
#: Names of page headers; in an article they hold its heading.
HEADERS = frozenset("header pageheader siteheader".split())
_WORDS = re.compile(r"[a-z]+").findall
_TAG_START = re.compile(r"<[a-zA-Z/!?]")


def _names(value: str, of: frozenset) -> bool:
    """Whether at least half of the words of one of the names in an attribute are among ``of``."""
    for name in value.lower().split():
        words = _WORDS(name)
        if words and 2 * sum(w in of for w in words) >= len(words):
            return True
    return False


class _Open:
    """An open element: its parent, whether it is firmly outside the main text, or perhaps (``weak``), and in an article.

    ``near`` is the nearest element, itself or around it, that is perhaps outside;
    ``cluster`` the characters of content lines in it.
    """

    __slots__ = ("article", "cluster", "firm", "head", "inside", "near", "parent", "region", "tag", "weak")

    def __init__(self, tag, parent, firm=False, weak=False, article=False, inside=False, region=None, head=False):
        self.tag, self.parent, self.firm, self.weak, self.article, self.inside, self.region, self.head = tag, parent, firm, weak, article, inside, region, head
        self.near, self.cluster = self if weak else parent and parent.near, 0


class Lines(HTMLParser):
    """Lines of a page, one for each run of text between block tags.

    A line is (text, text characters, tags, link characters, element).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Open("", None)
        self.stack, self.open = [self.root], Counter()
        self.lines: list[tuple] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                top = self.stack[-1]
                self.lines.append((text, len(text), self.tags, self.linked, top))
                self.tags = self.linked = 0

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            self.links += tag == "a"
            hidden = [v for k, v in attrs if k in ("class", "id", "role") and v]
            if not hidden or tag == "a":
                return
            if not any(_names(v, PARTS) for v in hidden):
                return
        elif tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        elif tag not in INLINE:
            self.flush()
        if tag not in INLINE and self.stack[-1].tag == "p":
            self._pop()
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack[-1].tag == tag:
            self._pop()
        top = self.stack[-1]
        names, hidden = [], False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names.append(v)
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                hidden = True
        article = tag in ("article", "main") or ("role", "main") in attrs
        page = tag in ("html", "body", "main")
        firm = top.firm or tag in OUTSIDE or hidden or not page and any(set(_WORDS(v.lower())) & READERS for v in names)
        part = not page and tag not in ("article", "table") and any(_names(v, PARTS) for v in names)
        titled = any(_names(v, HEADERS) for v in names)
        head = not page and tag != "article" and not top.inside and (tag == "header" or titled)
        own = _Open(tag, top, firm, part or head or tag == "form", article, top.inside or article, top.region, head and not part and not titled)
        if article and not top.inside:
            own.region = own
        self.stack.append(own)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in VOID or tag in INLINE and not self.open[tag]:
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        elif tag not in INLINE:
            self.flush()
        if self.open[tag]:
            if tag in INLINE and self.stack[-1].tag != tag:
                return
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.stack[-1].tag in ("script", "style"):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbouring lines; at the ends over those that exist."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]
    return np.convolve(ratios, kernel)[RADIUS:-RADIUS] / weight


def content_lines(lines: list[tuple]) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio is above the threshold."""
    ratios = np.array([n / max(1, tags) for _, n, tags, *_ in lines], dtype=float)
    smoothed = smooth(ratios)
    return smoothed > min(LAMBDA * smoothed.std(), smoothed.max() / 2)


def whole(html: str) -> str:
    """The page without a comment or a tag that its end cuts off; both are markup, and finding their end would take long."""
    open_at = html.rfind("<!--")
    if open_at >= 0 and html.find("-->", open_at) < 0:
        first = open_at
        while (before := html.rfind("<!--", 0, first)) >= 0 and html.find("-->", before) < 0:
            first = before
        html = html[:first]
    last = html.rfind(">") + 1
    cut = _TAG_START.search(html, last)
    return html[: cut.start()] if cut else html


def _outside(lines: list[tuple], content: np.ndarray) -> list[bool]:
    """For each line whether it is outside the main text.

    A named part, a form or a page header stands outside, but for one that holds
    most of the content cluster, and for a header beside paragraphs of it.  An
    article is main text also in a part.
    """
    total, beside = 0, set()
    for x, c in zip(lines, content, strict=True):
        if c and not x[4].firm:
            total += x[1]
            at = x[4].near
            while at is not None:
                at.cluster += x[1]
                at = at.parent and at.parent.near
            if x[4].tag == "p":
                beside.add(id(x[4].parent))
    known: dict[int, bool] = {}

    def out(at: _Open | None) -> bool:
        path = []
        while at is not None and id(at) not in known:
            if at.firm or at.weak and not (at.cluster > WRAPPER * total or at.head and id(at.parent) in beside):
                known[id(at)] = True
            elif at.article:
                known[id(at)] = False  # a firm part around it makes it firm
            else:
                path.append(id(at))
                at = at.parent
        answer = at is not None and known[id(at)]
        known.update(dict.fromkeys(path, answer))
        return answer

    return [out(x[4]) for x in lines]


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text, in page order."""
    parser = Lines()
    parser.feed(whole(html))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return []
    content = content_lines(lines)
    outside = _outside(lines, content)
    inside = [k for k, x in enumerate(outside) if not x]
    if not inside:
        return []
    chosen = [k for k in inside if content[k]] or inside
    # regions: all articles that hold content lines, or else the lowest element that holds all of them
    keep = {id(lines[k][4].region) for k in chosen if lines[k][4].region is not None}
    if keep:
        return [x[0] for k, x in enumerate(lines) if not outside[k] and x[4].region is not None and id(x[4].region) in keep and not _menu(x, content[k])]
    shared: list[_Open] = []
    for k in chosen:
        chain = _chain(lines[k][4])
        shared = [a for a, b in zip(shared, chain, strict=False) if a is b] if shared else chain
    while len(shared) > 1 and (shared[-1].tag in TEXTUAL or shared[-1].tag in INLINE):
        shared.pop()
    best = shared[-1]
    inner: dict[int, bool] = {id(best): True}

    def within(at: _Open | None) -> bool:
        path = []
        while at is not None and id(at) not in inner:
            path.append(id(at))
            at = at.parent
        answer = at is not None and inner[id(at)]
        inner.update(dict.fromkeys(path, answer))
        return answer

    return [x[0] for k, x in enumerate(lines) if not outside[k] and within(x[4]) and not _menu(x, content[k])]


def _chain(at: _Open | None) -> list[_Open]:
    """The element and those around it, from the root on."""
    out = []
    while at is not None:
        out.append(at)
        at = at.parent
    return out[::-1]


def _menu(line: tuple, content: bool) -> bool:
    """A line of links only, outside the content cluster, in a list."""
    return not content and line[3] >= line[1] > 0 and line[4].tag == "li"


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns ``keep``, ``text`` and ``n_chars`` (its code points).

    The standard library's parser streams its events; a line is the text
    between block tags, with its text-to-tag ratio.  Ratios are smoothed with a
    Gaussian over neighbouring lines, and lines above the threshold (a multiple
    of the standard deviation) form the content cluster.  The regions that hold
    the cluster, all articles with lines of it or else the lowest element (never
    a paragraph, list item or heading) around all of it, give the text: all their lines in page order but menus, adverts, notices, forms,
    comments of readers and other parts named as such.  References are decoded,
    white space in a block becomes one space, blocks are joined by an empty line.

    A null or empty page, or one without text, gives an empty text.  Nulls and
    repeated rows are kept as they are; an empty table gives an empty result;
    columns besides ``keep`` are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = pages.select(*keep, html_col)
    out = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(main_blocks(h.as_py() or "")) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow
            )

    return source.mapInArrow(run, out)
