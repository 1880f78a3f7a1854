"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams a page's events into blocks, the "lines" of
the method: runs of text between block-level tags. Each block has its text's
length outside links and the number of tags since the block before. Their ratio is
smoothed with a Gaussian over neighbouring blocks, and blocks at or above the
ratios' standard deviation form the content clusters.

Markup that names something else (menus, headers, footers, asides, forms, adverts,
notices, comments) takes its text out and counts as no text in the ratios; a wrapper
so named around next to all of the page's prose loses its name.

The clusters decide two things. Which region of the page is the article: the
innermost landmark (article, main) that holds most of the clustered text, or else
the innermost container that holds nearly all of it. And where the article begins
and ends: a landmark gives all its blocks but lists of links at its ends that no
cluster holds; in any other region the article runs from the first block of a
cluster to the last, with the headings before it and the short paragraphs beside
its own, and without lists of links outside the clusters, and it begins with the
region's one main heading if half of the clustered text or more follows that.

A page takes time in proportion to its length, however deep its elements nest.

Defined results: a null or empty page, or one without text, gives an empty text, as
does one that holds nothing but declared asides of less than a paragraph; unclosed
tags end with their parent, an unclosed head where the body begins; a page cut off
inside a tag or comment loses that tag; equal ratios are in or out of a cluster
together; very long pages are read whole; repeated rows stay; an empty table gives
an empty result; other columns of `pages`, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the neighbours at distance 0, 1 and 2: a Gaussian of standard deviation 1.
SIGMA, REACH = 1.0, 2
#: Share of its text that a block of a cluster has outside links.
MOSTLY = 0.5
#: Shares of the clustered text that a landmark, or any other container, has to hold.
LANDMARK, CONTAINER = 0.5, 0.95
#: Characters of prose from which a declared wrapper can be the article.
PARAGRAPH = 80

# The tags of each kind, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select button textarea input map".split())
#: What a head may hold; any other start tag, or text, ends a head that is still open.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
LANDMARKS = frozenset(("article", "main"))
CONTAINERS = frozenset(("article", "main", "div", "section", "body", "html", "td", "blockquote", "center"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that an opening tag closes, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table body html div article main section".split())
CLOSABLE = frozenset(("p", *CLOSES))

# Parts of a class or id that declare something other than the article, and parts that may stand beside them.
DECLARES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer footnav bottombar sidebar aside rail "
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion taboola outbrain "
    "cookie cookies consent gdpr notice notification alert popup modal overlay disclaimer newsletter subscribe subscription paywall "
    "share sharing social follow related recommended recommendations trending popular "
    "widget widgets toolbar pagination pager login signup register search searchbox form copyright legal skiplink tagcloud morestories".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
BESIDE = frozenset(
    "left right top bottom upper lower main site page global primary secondary article articles post posts entry story stories news content list box bar area wrap wrapper "
    "container inner outer holder block section slot unit button buttons btn icon icons link links item items text title heading body panel group row col column "
    "header us now up in out thread section google mobile desktop sticky fixed floating small large big mini new old first last message info".split()
)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_HEADER_NAMES = re.compile(r"(?:^|[_-])header(?:$|[_-])", re.I)
_OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)[_-]?header", re.I)
#: Parts that describe an element by what is around it, or by its state.
_STATES = re.compile(r"^(?:has|no|with|without|is|show|hide)[_-]|[_-](?:enabled|disabled|active|open|closed|visible|allowed)$", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@cache
def declared_by(name: str) -> str:
    """What a class or id declares: aside, comments, or nothing."""
    if _STATES.search(name):
        return ""
    parts = [x.lower() for x in _PARTS.findall(name)]
    while parts:  # the last part that isn't about place or shape says what it is
        for kind, core in (("comments", COMMENTS), ("aside", DECLARES)):
            if parts[-1] in core or "".join(parts[-2:]) in core:
                return kind
        if parts[-1] not in BESIDE and not parts[-1].isdigit() and len(parts[-1]) > 1:
            break
        parts.pop()
    return ""


class _Element:
    """An open or closed element; its descendants have the numbers up to `last`."""

    __slots__ = ("tag", "parent", "number", "last", "depth", "declared", "hidden", "silent", "head", "landmark", "block", "open", "mass")

    def __init__(self, tag, parent, number):
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.declared, self.hidden, self.mass = "", False, 0
        if parent is None:
            self.depth, self.silent, self.head, self.landmark, self.block, self.open = 0, False, False, False, self, {}
            return
        self.depth, self.silent, self.head, self.landmark = parent.depth + 1, parent.silent or tag in SILENT, parent.head, parent.landmark or tag in LANDMARKS
        self.block = self if tag in BLOCK else parent.block
        self.open = {} if tag in STOPS else parent.open
        if tag in CLOSABLE and tag not in self.open:
            self.open = {**self.open, tag: self}


class Blocks(HTMLParser):
    """Streams a page into blocks (element, text, characters outside links, tags)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, 0)
        self.elements = [self.at]
        self.count: Counter[str] = Counter()
        self.blocks: list[tuple[_Element, str, int, int]] = []
        self.text: list[str] = []
        self.plain = self.tags = 0
        self.owner = self.at

    def _end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.owner, text, self.plain, self.tags))
                self.tags = 0
            self.text, self.plain = [], 0

    def _pop_to(self, e: _Element) -> None:
        while self.at is not e:
            self.count[self.at.tag] -= 1
            self.at = self.at.parent

    def _declares(self, tag: str, attrs: dict, names: list[str]) -> str:
        """aside, comments or nothing."""
        if tag in ("html", "body"):
            return ""
        kinds = {declared_by(n) for n in names}
        if (attrs.get("itemprop") or "").lower() == "comment" or (attrs.get("itemtype") or "").lower().endswith("comment") or (tag not in HEADINGS and "comments" in kinds):
            return "comments"
        if tag in LANDMARKS:
            return ""
        if tag in ASIDE or (attrs.get("role") or "").lower() in ASIDE_ROLES or any(k == "data-ad" or k.startswith("data-ad-") for k in attrs):
            return "aside"
        return "aside" if tag not in HEADINGS and "aside" in kinds else ""

    def _close_head(self, tag: str) -> None:
        if not self.count["head"]:
            return
        e = self.at
        while tag == "body" and e.parent is not None and e.tag not in ("head", "template"):
            e = e.parent
        if e.tag == "head" and tag not in IN_HEAD:
            self._pop_to(e.parent)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self._close_head(tag)
        if tag in BLOCK:
            self._end_block()
            if tag != "br" and "p" in self.at.open:  # a paragraph ends where the next block begins
                self._pop_to(self.at.open["p"].parent)
            closed = [self.at.open[t] for t in CLOSES.get(tag, ()) if t in self.at.open]
            if closed:
                self._pop_to(min(closed, key=lambda e: e.number).parent)
        if tag in VOID:
            return
        attrs, up = dict(attrs), self.at
        e = self.at = _Element(tag, up, len(self.elements))
        self.elements.append(e)
        self.count[tag] += 1
        e.hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()
        header = tag == "header" or (tag in BLOCK and tag not in HEADINGS and any(_HEADER_NAMES.search(n) and not _STATES.search(n) for n in names))
        # the headings of an article's own header are part of it
        if header and (up.landmark or any(map(_OWN_HEADER.search, names))):
            e.head = True
        else:
            e.declared = "aside" if header else self._declares(tag, attrs, names)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._end_block()
        if self.count[tag] > 0 and tag:
            e = self.at
            while e.tag != tag:
                e = e.parent
            self._pop_to(e.parent)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._close_head("")
        if self.at.silent:
            return
        if not self.text:
            self.owner, e = self.at.block, self.at
            while e is not self.owner:  # text of an inline aside is that aside's own
                if e.declared or e.hidden:
                    self.owner = e
                    break
                e = e.parent
        self.text.append(data)
        if not self.count["a"]:
            self.plain += len(data)

    def finish(self) -> list[tuple[_Element, str, int, int]]:
        if re.match(r"<[A-Za-z/!?]", self.rawdata):  # cut off inside a tag or comment, which close() would take for text
            self.rawdata = ""
        self.close()
        self._end_block()
        for e in reversed(self.elements):
            if e.parent is not None:
                e.parent.last = max(e.parent.last, e.last)
        return self.blocks


def content_lines(plain: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which blocks are in a content cluster, by smoothed text-to-tag ratio."""
    ratio = plain / np.maximum(tags, 1)
    d = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(d**2) / (2 * SIGMA**2))
    # blocks beyond the page's ends repeat those at them
    smooth = np.convolve(np.pad(ratio, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= smooth.std()


def _weigh(elements: list[_Element], blocks: list, dense: np.ndarray) -> None:
    """Sets every element's mass, the characters of the given blocks within it."""
    for e in elements:
        e.mass = 0
    for (e, text, _, _), hit in zip(blocks, dense):
        if hit:
            e.mass += len(text)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.mass += e.mass


def _taken_out(elements: list[_Element], pardoned: set[int]) -> list[bool]:
    """For each element, whether it or one around it is hidden, or declared and not pardoned."""
    out = []
    for e in elements:
        out.append((e.parent is not None and out[e.parent.number]) or e.hidden or bool(e.declared and e.number not in pardoned))
    return out


def _pardoned(elements: list[_Element], out: list[bool]) -> set[int]:
    """The declared elements around the page's prose, if next to none of it lies elsewhere.

    The elements' masses are those of all prose that isn't hidden. A landmark that
    isn't declared, or more undeclared prose than `CONTAINER` leaves, keeps all
    declarations as they are, and comments never lose theirs.
    """
    inside: list[str] = []
    for e in elements:
        above = inside[e.parent.number] if e.parent is not None else ""
        inside.append("comments" if "comments" in (above, e.declared) else above or e.declared)
    own = [e.mass for e in elements]
    for e in elements:
        if e.parent is not None:
            own[e.parent.number] -= e.mass
    free = sum(m for e, m in zip(elements, own) if not out[e.number])
    if free >= (1 - CONTAINER) * elements[0].mass or any(e.tag in LANDMARKS and e.mass and not out[e.number] for e in elements):
        return set()
    may = [e for e in elements if e.mass >= PARAGRAPH and inside[e.number] == "aside" and not e.hidden]
    best = max([e for e in may if e.tag in LANDMARKS] or [e for e in may if e.declared], key=lambda e: (e.mass, e.depth), default=None)
    found = set()
    while best is not None:
        found.add(best.number)
        best = best.parent
    return found


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by line feeds."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    blocks, elements = parser.finish(), parser.elements
    if not blocks:
        return ""
    plain, size = np.array([b[2] for b in blocks], float), np.array([len(b[1]) for b in blocks], float)
    prose = plain >= MOSTLY * size
    at = np.array([b[0].number for b in blocks])
    seen = ~np.array(_taken_out(elements, {e.number for e in elements}))[at]
    own_head = np.array([not e.head or e.tag in HEADINGS for e, *_ in blocks])

    _weigh(elements, blocks, prose & own_head & seen)
    out = _taken_out(elements, set())
    pardoned = _pardoned(elements, out)
    if pardoned:
        out = _taken_out(elements, pardoned)
    mine = ~np.array(out)[at] & own_head
    if not mine.any():
        return ""
    # what is taken out counts for nothing
    ratio = content_lines(np.where(mine, plain, 0.0), np.array([b[3] for b in blocks], float))
    clustered = ratio & prose & mine
    dense = clustered if clustered.any() else mine
    _weigh(elements, blocks, dense)
    total = elements[0].mass
    marks = [e for e in elements if e.tag in LANDMARKS and e.mass >= LANDMARK * total]
    rest = [e for e in elements if e.parent is None or (e.tag in CONTAINERS and e.mass >= CONTAINER * total)]
    region = max(marks or rest, key=lambda e: e.depth)

    mine &= (at >= region.number) & (at <= region.last)
    hits = np.flatnonzero(dense & mine)
    first, last = hits[0], hits[-1]
    between = np.zeros(len(blocks), bool)
    between[first : last + 1] = True
    if marks:
        linked = ~prose & ~ratio & np.array([e.tag not in HEADINGS and e.tag != "p" for e, *_ in blocks])
        keep = mine & (between | ~linked)
    else:
        alike = {(blocks[i][0].tag, id(blocks[i][0].parent)) for i in hits}
        keep = np.array([(e.tag, id(e.parent)) in alike for e, *_ in blocks]) | between
        first = int(np.flatnonzero(keep & mine)[0])
        while first > 0 and blocks[first - 1][0].tag in HEADINGS:
            first -= 1
            keep[first] = True
        titles = [i for i in np.flatnonzero(mine) if blocks[i][0].tag == "h1"]
        if len(titles) == 1 and size[hits[hits >= titles[0]]].sum() >= 0.5 * size[hits].sum():
            keep[: titles[0]] = False
        linked = ~prose & ~ratio
        linked[1:-1] &= linked[:-2] | linked[2:]  # a list has two at least
        keep &= mine & ~linked
    return "\n".join(b[1] for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
