"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold clusters.

The standard library's streaming parser turns a page into lines, one for each block element, each
with its text, the number of tags on it and the containers that it stands in. A line's ratio of
characters to tags is smoothed with a Gaussian over its neighbours; lines at or above the threshold
(``SPREAD`` standard deviations of the smoothed ratios) are content and pick the region: all
outermost article or main elements if any of them holds content, or else these and the smallest container that
holds all content. A region without an h1, and without a heading at its beginning, gets the nearest h1
before it unless content stands in between. In the region, lists and
divisions of links alone (two at least) go if the ratio of each of their lines is below the threshold, but for
one right below a heading of the article (its references). Every other line
belongs to the result, short ones too, but for what is marked as boilerplate: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, hidden parts and reader comments. In an article, words that name its subjects as well
("related", "social") mark a part only if the ratio agrees: most of its characters are linked, or no line
of it reaches ``PROSE`` characters a tag. Short text alone is not rejected: articles have
paragraphs of a word or two, which the ratio can't tell from unmarked adverts.

Repeated rows are scanned again, an empty table gives an empty one, and columns beside page_id, url and html
are ignored, whatever they are called. An article in an article is part of it.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SIGMA, RADIUS, SPREAD, PROSE = 1.0, 2, 0.5, 8.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center dd div dl fieldset main ol section table tbody td ul".split())
LISTS = CONTAINERS - frozenset("body dd main td".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("address aside blockquote caption details dt figcaption figure footer form header hgroup html legend li nav noscript p pre summary tfoot thead title tr".split())
DROPPED = frozenset("aside audio button canvas dialog footer form iframe menu nav noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark boilerplate.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner branding breadcrumb breadcrumbs byline consent cookie cookies dialog disqus footer gdpr login logo masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommendations recommended related reply replies respond share sharebar sharing sidebar signup sitefooter social "
    "sponsor sponsored subscribe subscription toolbar trending widget widgets".split()
)
#: Those that also name what an article is about.
SUBJECTS = frozenset("branding login logo navigation overlay promotion recommendations recommended related sharing social subscription toolbar trending".split())
COMMENTS = frozenset("comment comments commentlist".split())
#: Words that begin with "comment" and don't name reader comments, and words after it that tell whether a page takes any.
COMMENTARY = frozenset("commentaries commentary commentator commentators commented".split())
STATES = frozenset("allowed closed disabled enabled off on open".split())
#: Words before a mark that make it a statement about the page ("has-sidebar", "no-ads").
ABOUT = frozenset("has hide is no not with without".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _marked(tag: str, attrs: list, inside: bool = False) -> str | None:
    """'drop' or 'header' if the attributes mark a part as boilerplate, 'doubt' if the ratio has to agree (``inside`` an article).

    Class and id words don't count on what may hold a whole page, but for an article that is a reader comment by name.
    """
    doubt = None
    whole = tag in ("html", "body", "main", "article")
    for name, value in attrs:
        if name in ("class", "id") and value:
            for part in value.split():
                if tag == "article" and part.lower() in COMMENTS:
                    return "drop"
                found = [] if whole else [w.lower() for w in _word.findall(part)]
                for before, w, after in zip(["", *found], found, [*found[1:], ""]):
                    if w.startswith("comment") and w not in COMMENTARY and before not in ABOUT and after not in STATES:
                        return "drop"
                    if before not in ABOUT:
                        if w in MARKS and not (inside and w in SUBJECTS):
                            return "drop"
                        if w in MARKS:
                            doubt = "doubt"
                        if w == "header":
                            return "header"
        elif name == "role" and value and value.lower() in ROLES:
            return "drop"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return "drop"
    return doubt


class Lines(HTMLParser):
    """Collects (text, tags, linked characters, links, heading, containers, part in doubt) for each block of a page.

    heading: 1 in an h1, 2 in any other, or else 0; part in doubt: the number of the outermost one, 0 without.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, tuple, int]] = []
        self.open: list[tuple[str, str | None]] = []
        self.within: tuple = ()  # numbers of the open containers
        self.kinds: list[str] = []
        self.doubts: list[int] = []  # open parts in doubt
        self.parts: list[str] = []
        self.tags = self.links = self.linked = self.anchors = self.dropped = self.headers = self.headings = self.titles = self.doubted = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.anchors, 1 if self.titles else 2 if self.headings else 0, self.within, self.doubts[0] if self.doubts else 0))
        if text or self.parts:
            self.tags = 0
        self.parts, self.linked, self.anchors = [], 0, 0

    def pop(self) -> None:
        tag, mark = self.open.pop()
        if tag in BLOCKS or mark == "doubt":
            self.flush()
        if mark == "doubt":
            self.doubts.pop()
        if tag in CONTAINERS:
            self.within = self.within[:-1]
        self.links -= tag == "a"
        self.headings -= tag in HEADINGS
        self.titles -= tag == "h1"
        self.dropped -= mark == "drop"
        self.headers -= mark == "header"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.pop()
        for back in range(len(self.open) - 1, -1, -1):  # an unclosed inline element doesn't keep a paragraph open
            name = self.open[back][0]
            if name in BLOCKS or name in CLOSED_BY:
                if tag in CLOSED_BY.get(name, ()):
                    while len(self.open) > back:
                        self.pop()
                break
        if tag in ("article", "main", "body"):  # a menu or page header that was never closed ends here
            for back, (name, _) in enumerate(self.open):
                if name in ("nav", "header", "title"):
                    while len(self.open) > back:
                        self.pop()
                    break
        if tag in BLOCKS:
            self.flush()
        elif tag == "th":
            self.parts.append(" ")
        inside = bool(attrs or tag == "header") and any(self.kinds[k] in ("article", "main") for k in self.within)
        mark = "drop" if tag in DROPPED else _marked(tag, attrs, inside) if attrs else None
        if tag == "header" or mark == "header":
            mark = "drop" if mark == "drop" or not inside else "header"
        if mark == "doubt":
            self.flush()
            self.doubted += 1
            self.doubts.append(self.doubted)
        self.open.append((tag, mark))
        if tag in CONTAINERS:
            self.within = (*self.within, len(self.kinds))
            self.kinds.append(tag)
        self.links += tag == "a"
        self.anchors += tag == "a"
        self.headings += tag in HEADINGS
        self.titles += tag == "h1"
        self.dropped += mark == "drop"
        self.headers += mark == "header"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("script", "style", "iframe", "svg", "canvas"):
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if any(name == tag for name, _ in self.open):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.dropped and (not self.headers or self.headings):
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over neighbouring lines; weights beyond either end are left out."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def select(lines: list, kinds: list[str]) -> list[str]:
    """The lines of the content region."""
    if not lines:
        return []
    texts, tags, linked, anchors, headings, withins, doubts = zip(*lines)
    ratios = np.array([len(text) / max(1, n) for text, n in zip(texts, tags)])
    smoothed = smooth(ratios)
    threshold = SPREAD * smoothed.std()
    links = [n * 2 > len(text) for text, n in zip(texts, linked)]
    content = [within for within, s, link in zip(withins, smoothed, links) if s >= threshold and not link]
    marked = {k for k, kind in enumerate(kinds) if kind in ("article", "main")}
    inside = [not marked.isdisjoint(within) for within in withins]
    if not any(inside) or content and all(marked.isdisjoint(within) for within in content):
        region = max(set(content[0]).intersection(*content[1:]), default=None) if content else None  # containers are numbered as they open
        inside = [i or region is None or region in within for i, within in zip(inside, withins)]
    boilerplate = doubtful(texts, ratios, linked, links, headings, doubts)
    listed: dict[int, float] = {}  # links of each container of links alone
    cited = set()  # those right below a heading
    for i, within in enumerate(withins):
        for k in within:
            if kinds[k] in LISTS:
                if k not in listed and i and headings[i - 1] == 2 and inside[i - 1]:
                    cited.add(k)
                listed[k] = listed.get(k, 0) + anchors[i] if links[i] and ratios[i] < threshold else -math.inf
    listed = {k for k, n in listed.items() if n > 1 and k not in cited}
    kept = [i and listed.isdisjoint(within) and part not in boilerplate for i, within, part in zip(inside, withins, doubts)]
    if not any(kept):
        kept = inside
    first = kept.index(True) if True in kept else 0
    if not headings[first] and not any(k and heading == 1 for k, heading in zip(kept, headings)):
        for i in range(first - 1, -1, -1):
            if headings[i] == 1:
                kept[i] = True
                if not i or headings[i - 1] != 1:
                    break
            elif ratios[i] >= threshold and not links[i]:
                break
    return [text for text, k in zip(texts, kept) if k]


def doubtful(texts, ratios, linked, links, headings, doubts) -> set[int]:
    """The parts in doubt that are boilerplate by their ratio or their links."""
    found = set()
    for part in set(doubts) - {0}:
        own = [i for i, x in enumerate(doubts) if x == part]
        reached = any(ratios[i] >= PROSE and not (links[i] or headings[i]) for i in own)
        if not reached or 2 * sum(linked[i] for i in own) > sum(len(texts[i]) for i in own):
            found.add(part)
    return found


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by two line feeds; null or no content: ''."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    return "\n\n".join(select(page.lines, page.kinds))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row. Null ids and urls stay null."""

    def scan(frames):
        import pyarrow as pa

        for frame in frames:
            for start in range(0, frame.num_rows, 512):
                part = frame.slice(start, 512)
                found = [main_text(x) for x in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(tidy(scan), "page_id long, url string, text string, n_chars long")
