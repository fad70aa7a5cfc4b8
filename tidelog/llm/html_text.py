"""Main text of web pages by text-to-tag ratio over standard-library parser events.

The parser's events become lines, one for each block: its text, the tags since
the line before, and the element it stands in. A line's ratio is its characters
by tag, 0 in what the markup itself sets apart (menus, headers and footers of
the page, asides, adverts, notices, forms, reader comments). Ratios are smoothed
by a Gaussian and cut at a share of their deviation; lines above, smoothed and
by themselves, are clusters.

The clusters choose regions. If most of their text lies in articles or main
parts, nested or side by side, each outermost of these that a cluster touches is
a region; else the whole page is one. Of a region come: all lines that stand
directly in an element in which a cluster's line stands (so short paragraphs
between and after long ones stay), the lines between the first and the last of
these, and in articles and main parts also lines beyond them whose smoothed
ratio reaches a lower cut (``EVIDENCE``). What stands directly in the body of a
page without an article is held to the lower cut. Nothing that is set apart comes.

Names of classes and ids set apart by whole words of the attribute, but neither
headings, nor an element with an article or main part in it unless such a part
stands outside all of them, nor one that holds most of the page's text, nor all
of a page. A form around an article, or around most of a page without one, is
borne like any other element.

Case handling: null html is empty; a page without text, or with nothing left,
gives the empty text; unclosed and stray tags are borne (an end tag closes back
to its own start, or is ignored), a tag that never ends is text if no ``>``
follows and left out to the next one else, as is a comment that never ends; time
and memory are linear in the page; text of any length is kept whole; repeated
rows, ties and further columns, whatever their names, change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, texts

#: Deviation and reach of the Gaussian in lines; share of the ratios' deviation at which they are cut.
SIGMA, REACH, CUT = 1.0, 2, 0.5
#: Factor on the cut for lines at the ends of a region.
EVIDENCE = 0.1
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist audio video".split())
APART = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HELD = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Elements that flow with the text around them: their lines stand in what they stand in.
FLOW = frozenset("blockquote details dl fieldset figure ol table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = frozenset("dd dt li p td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names that set apart; a word of a class or id is one, or several and parts that say nothing, joined by hyphens.
NAME = r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|side-?bar|side|menu|nav|navbar|navigation|breadcrumbs?|share|sharing|social|comments?|commentlist|disqus|respond|replies|related|recommended|newsletter|subscribe|signup|login|pop-?up|modal|overlay|footer|masthead|site-header|page-header|header|widgets?|toolbar|pagination|pager|tags)"
PLAIN = r"(?:\d+|bars?|box|block|buttons?|links?|list|top|bottom|left|right|primary|secondary|site|page|main|post|section|area|inner)"
NAMES = re.compile(rf"(?:{PLAIN}[_-]+)*{NAME}(?:[_-]+(?:{NAME}|{PLAIN}))*", re.I)


class Lines(HTMLParser):
    """Lines (text, tags, element) of a page and its elements, each after what it stands in; element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        #: Of each element: what it stands in, tag, whether it is unseen, set apart by markup, by a name, a landmark.
        self.parent, self.tag, self.unseen, self.apart, self.named, self.mark = [0], [""], [False], [False], [False], [False]
        self.open, self.count = [0], Counter()
        self.text: list[str] = []
        self.tags, self.endless = 0, False

    def _line(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.lines.append((text, self.tags, self.open[-1]))
            self.tags = 0
        self.text.clear()

    def _pop(self) -> str:
        tag = self.tag[self.open.pop()]
        self.count[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._line()
            top = self.tag[self.open[-1]]
            if top in ("p", "head") or top == tag and tag in ITEMS:
                self._pop()
        if tag in VOID:
            return
        at, named = self.open[-1], dict(attrs)
        sets = tag in APART or tag == "header" and not self.mark[at] or "hidden" in named or named.get("aria-hidden") == "true"
        if not sets and tag not in WHOLE:
            sets = (named.get("role") or "").lower() in ROLES
        name = not sets and tag not in WHOLE and tag not in HEADINGS and any(NAMES.fullmatch(w) for k in ("class", "id") for w in (named.get(k) or "").split())
        if tag in HELD or tag in UNSEEN or sets or name:
            if tag not in BLOCKS and (sets or name):
                self._line()
            self.open.append(len(self.parent))
            self.count[tag] += 1
            self.parent.append(at)
            self.tag.append(tag)
            self.unseen.append(self.unseen[at] or tag in UNSEEN)
            self.apart.append(sets)
            self.named.append(name)
            self.mark.append(self.mark[at] or tag in ("article", "main"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.count[tag] or tag in BLOCKS:
            self._line()
        if self.count[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.unseen[self.open[-1]]:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._line()

    def _past(self, at: int, end: int) -> int:
        """Where to go on after markup that begins at a place and ends at another, or nowhere (negative)."""
        if end >= 0:
            return end
        end = self.rawdata.find(">", at)
        if end < 0:
            self.handle_data(unescape(self.rawdata[at:]))
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self._past(i, super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._past(i, super().parse_endtag(i))

    def parse_pi(self, i: int) -> int:
        return self._past(i, super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            return self._past(i, -1)  # to its first ">", as browsers take it
        return self._past(i, super().parse_html_declaration(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = -1 if self.endless else super().parse_comment(i, report)
        self.endless |= end < 0
        return self._past(i, end)


def _up(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Sums over each element and all that stands in it."""
    total = values.tolist()
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    return np.array(total)


def _down(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Whether an element, or any that it stands in, has the mark."""
    marked = own.tolist()
    for k in range(1, len(parent)):
        marked[k] = marked[k] or marked[parent[k]]
    return np.array(marked, bool)


def set_apart(page: Lines, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: whether it is set apart, and the outermost landmark that it stands in (0 is none)."""
    n, parent, tags = len(page.parent), page.parent, page.tag
    apart, named = np.array(page.apart), np.array(page.named)
    own = np.array([t in ("article", "main") for t in tags])
    inside = _up(parent, np.bincount(at, size, n))
    forms = np.array([t == "form" for t in tags]) & apart
    if forms.any():
        other = _down(parent, apart & ~forms)
        apart &= ~(forms & ((_up(parent, own & ~other) > 0) | ~(own & ~other).any() & (2 * inside > size.sum())))
    apart = _down(parent, apart)
    shown = np.bincount(at, np.where(apart[at], 0, size), n)
    if named.any():
        inside, under = _up(parent, shown), _down(parent, named)
        marked = own & ~apart
        if not (marked & ~under & (inside > 0)).any():
            named &= ~((_up(parent, marked & (inside > 0)) > 0) | (2 * inside > shown.sum()))
            under = _down(parent, named)
        if (under | (shown == 0)).all():
            under[:] = False
        apart |= under
    landmark = [0] * n
    for k in range(1, n):
        landmark[k] = landmark[parent[k]] or (k if own[k] and not apart[k] else 0)
    return apart, np.array(landmark)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios under a normalised Gaussian; the ends reflect."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    wide = np.pad(ratios, REACH, mode="symmetric") if len(ratios) >= REACH else np.pad(ratios, REACH, mode="edge")
    return np.convolve(wide, kernel / kernel.sum(), mode="valid")


def region(page: Lines) -> list[str]:
    """Texts of the lines that belong to the page's content."""
    if not page.lines:
        return []
    size, tags, at = (np.array(x) for x in ([len(line[0]) for line in page.lines], [line[1] for line in page.lines], [line[2] for line in page.lines]))
    apart, landmark = set_apart(page, size, at)
    apart, landmark = apart[at], landmark[at]
    ratios = np.where(apart, 0.0, size / np.maximum(1, tags))
    smooth = smoothed(ratios)
    cut = CUT * smooth.std()
    core = (smooth >= cut) & (ratios >= cut) & ~apart
    likely = (smooth >= EVIDENCE * cut) & ~apart
    stands = [0]
    for k in range(1, len(page.parent)):
        stands.append(stands[page.parent[k]] if page.tag[k] in FLOW else k)
    stands = np.array(stands)[at]
    if 2 * size[core & (landmark > 0)].sum() >= max(1, size[core].sum()):
        core &= landmark > 0
        at_ends = likely & (landmark > 0)
        whole = np.ones(len(at), bool)
    else:
        landmark = np.ones(len(at), np.int64)
        whole = ~np.isin(stands, [k for k, t in enumerate(page.tag) if t in ("", "body")])
        at_ends = core
    beside = np.isin(stands, stands[core]) & ~apart & (landmark > 0) & (whole | likely)
    ends = np.flatnonzero(beside | at_ends)
    first, last = np.full(len(page.parent) + 1, len(at)), np.full(len(page.parent) + 1, -1)
    np.minimum.at(first, landmark[ends], ends)
    np.maximum.at(last, landmark[ends], ends)
    place = np.arange(len(at))
    taken = np.isin(landmark, landmark[core]) & (first[landmark] <= place) & (place <= last[landmark])
    return [line[0] for line, x, y in zip(page.lines, taken.tolist(), apart.tolist()) if x and not y]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    return " ".join(region(page))


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [main_text(x.decode("utf-8", "replace") if x else None) for x in texts(part.column(2))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each page."""
    prepare(pages.sparkSession)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
