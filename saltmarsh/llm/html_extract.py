"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams its events; text between block tags is a line.  A line's score is its
text that is no link, divided by its tags, times what speaks for or against it: an article around it, a
paragraph; or that the page itself names it as something else (navigation, aside, form, header and footer of the page, hidden
elements, and elements whose class, id or role says advert, menu, comments and so on).  Nothing is ruled out by a name alone.
The scores in page order are smoothed with a Gaussian; a threshold from clustering the smoothed scores into low and high ones
leaves contiguous regions of high lines; an article with a high line is in its region as a whole.  A line that something speaks
against must reach the threshold by itself; at the ends of a region so must any line but those of an article; headings right before
a region belong to it.  All regions are the text, in page order; where no line is high, all lines with a score are.

A class of words that all say so speaks against its element strongly, one with another word beside them ("social-history") only
a little, and only outside an article or around no main heading; a first word like "has" or "no" says what else is on the page.

Null and empty pages give an empty text; pages without markup are their text; scores at the threshold
count as high; repeated rows are rows of their own; an empty table gives an empty result; other columns are
left out.  Pages are read whole, in time linear in their length; nothing is cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces

# Names of elements.
UNSEEN = frozenset("script style noscript template head title svg math canvas iframe object audio video map select option datalist button textarea input".split())
IN_HEAD = frozenset("head title meta link style script base noscript template html".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of a class, id or role that say what an element is, surely or likely, and words that add nothing to them.
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar footer masthead"
    " cookie cookies consent gdpr popup modal newsletter subscribe subscription share sharing social comment comments commentlist disqus hidden complementary contentinfo".split()
)
LIKELY = frozenset(
    "side aside rail widget toc header topbar toolbar bottom copyright legal notice notices alert overlay dialog toast signup login register search form follow related recommended recommendations trending popular"
    " discussion replies reply responses respond review reviews skip".split()
)
NEUTRAL = frozenset(
    "site main page top left right inner outer wrap wrapper container content box block area section list item items group row column col bar panel slot unit links link buttons button icons icon label title text body head js"
    " primary secondary global sticky fixed close small large mobile desktop google".split()
)
#: Words of a class that says what else is on the page, if they come first or last.
ABOUT = frozenset("has no with without is not show open closed enabled disabled allowed".split())
PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])|[\s_-]+|(?<=\D)(?=\d)")

SIGMA = 1.0
#: What the score of a line is multiplied by: inside article or main, in a paragraph, under a name that surely or likely says
#: something else, and in an element that is no content.
ARTICLE, PARAGRAPH, SURE, LIKELY_NOT, CHROME_SCORE = 2.0, 1.25, 0.02, 0.5, 0.005
#: Least threshold, in characters a tag.
LEAST = 3.0


class Line:
    __slots__ = ("words", "size", "tags", "linked", "inside", "heading", "prose", "excluded", "marker")

    def __init__(self):
        self.words: list[str] = []
        self.size = self.tags = self.linked = 0
        self.inside = self.heading = self.prose = self.excluded = False
        self.marker = 0


class Marker:
    """An element with a word in its class, id or role, and what ``said`` gives for it; marker 0 is none."""

    __slots__ = ("outer", "word", "titles")

    def __init__(self, outer: int, word: int, titles: int):
        self.outer, self.word, self.titles = outer, word, titles


def said(value: str) -> int:
    """What a class, id or role says: 3 surely no article, 2 likely none, 1 one of such words beside others, 0 nothing."""
    most = 0
    for name in value.split():
        parts = [p.lower() for p in PARTS.split(name) if p]
        if not parts or parts[0] in ABOUT or parts[-1] in ABOUT:
            continue
        alone = all(p in CERTAIN or p in LIKELY or p in NEUTRAL or p.isdigit() for p in parts)
        if CERTAIN.intersection(parts):
            most = max(most, 3 if alone else 1)
        elif LIKELY.intersection(parts):
            most = max(most, 2 if alone else 1)
    return most


class Events(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # name, unseen, excluded, marker before it
        self.names: Counter[str] = Counter()
        self.markers = [Marker(0, 0, 0)]
        self.around: set[int] = set()  # markers with a main heading inside
        self.unseen = self.excluded = self.links = self.titles = self.marker = 0
        self.line: Line | None = None
        self.parts: list[str] = []

    def end_line(self) -> None:
        if self.line is not None:
            self.line.words = "".join(self.parts).split()
            if self.line.words:
                self.line.size = sum(map(len, self.line.words))
                self.lines.append(self.line)
        self.line, self.parts = None, []

    def here(self) -> Line:
        if self.line is None:
            line = self.line = Line()
            line.inside = any(self.names[n] for n in CONTENT)
            line.heading = any(self.names[n] for n in HEADINGS)
            line.prose = any(self.names[n] for n in PROSE)
            line.excluded, line.marker = self.excluded > 0, self.marker
        return self.line

    def leaves_article(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in CHROME or tag == "header" and not any(self.names[n] for n in CONTENT):
            return True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.names["head"] and tag not in IN_HEAD:
            self.handle_endtag("head")
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if not self.unseen:
                self.here().tags += 1
            return
        for closed in CLOSED_BY.get(tag, ()):
            if self.open and self.open[-1][0] == closed:
                self.handle_endtag(closed)
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")
        unseen = tag in UNSEEN
        out = tag not in ("html", "body") and self.leaves_article(tag, attrs)
        self.open.append((tag, unseen, out, self.marker))
        word = max((said(v) for n, v in attrs if n in ("class", "id", "role") and v), default=0) if tag not in HEADINGS and tag not in ("html", "body", "main") else 0
        if word:
            self.markers.append(Marker(self.marker, word, self.titles))
            self.marker = len(self.markers) - 1
        self.names[tag] += 1
        self.unseen += unseen
        self.excluded += out
        self.links += tag == "a"
        self.titles += tag in ("h1", "main")
        if not self.unseen and tag not in BLOCKS:
            self.here().tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_one(self) -> None:
        tag, unseen, out, marker = self.open.pop()
        self.names[tag] -= 1
        self.unseen -= unseen
        self.excluded -= out
        self.links -= tag == "a"
        if marker != self.marker:
            if self.titles > self.markers[self.marker].titles:
                self.around.add(self.marker)
            self.marker = marker

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if not self.names[tag]:
            return
        if tag not in BLOCKS:  # an inline end tag closes nothing outside its block
            for name, *_ in reversed(self.open):
                if name == tag:
                    break
                if name in BLOCKS:
                    return
        while self.open:
            last = self.open[-1][0]
            self.close_one()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.unseen or not data:
            return
        line = self.here()
        self.parts.append(data)
        if self.links:
            line.linked += len("".join(data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        while self.open:
            self.close_one()
        return self.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel, mode="valid")


def threshold(smoothed: np.ndarray) -> float:
    """Halfway between the centres of low and high scores, as logarithms."""
    logs = np.log1p(smoothed)
    low, high = logs.min(), logs.max()
    for _ in range(20):
        cut = (low + high) / 2
        below = logs < cut
        if not below.any() or below.all():
            break
        now = logs[below].mean(), logs[~below].mean()
        if now == (low, high):
            break
        low, high = now
    return max(float(np.expm1((low + high) / 2)), LEAST)


def scores(events: Events) -> tuple[np.ndarray, np.ndarray]:
    """The score of every line, and whether it is marked, so that it must reach the threshold by itself."""
    strength = [0]  # of the markers around a line
    for at, marker in enumerate(events.markers[1:], 1):
        own = 0 if at in events.around else marker.word
        strength.append(max(own, strength[marker.outer]))
    out, marked = np.zeros(len(events.lines)), np.zeros(len(events.lines), dtype=bool)
    for i, line in enumerate(events.lines):
        against = strength[line.marker]
        ratio = (line.size - min(line.linked, line.size)) / max(line.tags, 1)
        if line.excluded:
            ratio *= CHROME_SCORE
        if against:
            ratio *= SURE if against == 3 or against == 2 and not line.inside else LIKELY_NOT
        if not line.excluded and not against:
            ratio *= (ARTICLE if line.inside else 1) * (PARAGRAPH if line.prose else 1)
        out[i], marked[i] = ratio, line.excluded or against > 1 or against == 1 and not line.inside
    return out, marked


def chosen(own: np.ndarray, marked: np.ndarray, headings: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which lines are content."""
    smoothed = smooth(own)
    least = threshold(smoothed)
    reached = own >= least
    above = smoothed >= least
    article = inside & ~marked
    runs = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(int)))
    for a, b in runs.reshape(-1, 2).tolist():  # an article with a high line of its own is a region as a whole
        if (above & article)[a:b].any():
            above[a:b] |= article[a:b]
    keep = np.zeros(len(own), dtype=bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], above, [False]]).astype(int)))
    for a, b in edges.reshape(-1, 2).tolist():
        while a < b and not reached[a] and not article[a] and not (headings[a] and not marked[a]):
            a += 1
        while a < b and not reached[b - 1] and not article[b - 1]:
            b -= 1
        while a < b and a and headings[a - 1] and not marked[a - 1]:
            a -= 1
            above[a] = True
        keep[a:b] = (above & (~marked | reached))[a:b]
    return keep if keep.any() else (own > 0)


def main_text(html: str) -> str:
    events = Events()
    events.feed(html)
    lines = events.finish()
    if not lines:
        return ""
    own, marked = scores(events)
    keep = chosen(own, marked, np.array([x.heading for x in lines]), np.array([x.inside for x in lines]))
    return " ".join(w for x, kept in zip(lines, keep.tolist(), strict=True) if kept for w in x.words)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    some = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(some.dtypes)
    return some.mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
