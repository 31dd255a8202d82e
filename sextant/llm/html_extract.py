"""Main text of web pages from streamed parser events.

The standard library's parser turns a page into lines: the text between two block borders, with the
number of tags in it. Scripts, styles, controls and the like are never text and make no lines. The logarithms of
all other lines' text-to-tag ratios, menus and adverts too, are smoothed with a Gaussian and split into two clusters. A line's worth is its smoothed
value over the level between the clusters, less what the marked elements around it cost: ``PRIOR`` for a menu, footer or notice by its tag or role,
``NAME_PRIOR`` for one by its name alone or a form, and the less the more of the page's text it holds.

The content region grows from its centre, the innermost section that holds more than half of the upper cluster's text, to
that section around it with the largest sum of worths beyond the centre. Inside the region everything is kept, short lines too,
but marked elements whose worths sum to less than nothing. A title (h1) before the region joins it if it has none of its own.
That an element is an article or main element does not make it the region; but no section inside one is taken without the rest of it.

Each page is handled alone while Arrow batches stream; no shuffle; memory and time grow with the page's length. Defined
results: null or empty html, or a page without text, gives the empty string. Unclosed and stray tags are closed at
the next border or ignored. Repeated pages keep their rows. Nothing is cut at any length; only a comment
that is opened in markup and never closed runs to the end of the page, as in browsers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
SPACED = frozenset("br td th".split())
CONTAINERS = frozenset("html body main article section div td table ul ol dl blockquote center header footer aside nav form".split())
#: A list, table, cell or quote is a part of an article, never the whole.
REGIONS = frozenset("html body main article section div center header footer aside nav form".split())
#: What can never be text.
DROPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video head title button select textarea dialog".split())
MARKED_TAGS = frozenset("nav footer aside menu".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id attributes (split at anything but letters) that may mark what is not the article.
MARKED_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus discussion footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related replies respond share sharing sidebar signup sitenav social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: These name readers' answers, however much text they hold.
ANSWER_WORDS = frozenset("comment comments commentlist discussion disqus replies respond".split())
NEVER_MARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: A layout that says it has a sidebar is not one.
LAYOUT_WORDS = frozenset("has with no without".split())
#: Next to a marking word these say that the element holds an article.
ARTICLE_WORDS = frozenset("article entry story work works".split())
HEAD_WORDS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These end an open element of the same group.
IMPLIED_END = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that the stack has to know; others, such as bold type, change nothing.
KNOWN = CONTAINERS | DROPPED | MARKED_TAGS | frozenset(IMPLIED_END) | HEADINGS
SIGMA = 1.0
#: What an element that is marked by tag, role or as readers' answers costs its lines, in logarithms of the ratio; and one marked by a name alone, or a form.
PRIOR, NAME_PRIOR = 8.0, 2.7
#: Lines of more characters a tag than this are text, however much longer others are.
TEXT_RATIO = 20
#: Characters of text that a page is taken to have beside its own when an element's share of it is judged.
OTHER_CHARS = 1_500
#: Elements whose content is text: a comment sign in them opens no comment that runs past their end.
TEXT_ELEMENTS = frozenset("title textarea iframe noscript xmp noembed noframes".split())
_COMMENT_END = re.compile(r"--(?:!|\s*)>")
_TAG_START = re.compile(r"<[A-Za-z/!?]")
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _name_words(name: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))}


@dataclass
class Element:
    """A container or marked element. Its descendants have the numbers after its own up to ``end``."""

    tag: str
    parent: int
    marked: int  # 0: no, 1: by a name alone, 2: by its tag, role or as readers' answers
    end: int = 0


@dataclass
class Line:
    text: str
    tags: int
    element: int  # the innermost around it
    title: bool = False
    heading: bool = False


@dataclass
class _Open:
    tag: str
    element: int
    dropped: bool


class LineParser(HTMLParser):
    """Collects the lines of a page and its elements. Element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element("html", -1, 0)]
        self.stack = [_Open("", 0, False)]
        self.open: Counter[str] = Counter()  # tags on the stack
        self.dropping = 0
        self.parts: list[str] = []
        self.tags = 0
        self.ends: dict[str, int] = {}  # where the next end tag of a text element stands

    def _end_of(self, tag: str, i: int) -> int:
        """Place of the next end tag at or after ``i``; the length of the page if there is none."""
        if self.ends.get(tag, -1) < i:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.rawdata, i)
            self.ends[tag] = found.start() if found else len(self.rawdata)
        return self.ends[tag]

    def parse_comment(self, i: int, report: int = 1) -> int:
        """End of the comment opened at ``i``. The parser calls this in markup only: not in scripts, styles or tags."""
        page = self.rawdata
        for empty in (">", "->"):
            if page.startswith(empty, i + 4):
                return i + 4 + len(empty)
        inside = next((t for t in TEXT_ELEMENTS if self.open[t]), None)
        border = len(page) if inside is None else self._end_of(inside, i)
        if closed := _COMMENT_END.search(page, i + 4, border):
            return closed.end()
        if border < len(page):
            self.handle_data(page[i:border])
        return border

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.stack[-1].element, self.open["h1"] > 0, any(self.open[t] for t in HEADINGS)))
        self.parts.clear()
        self.tags = 0

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """How an element is marked: see ``Element``."""
        if tag in NEVER_MARKED:
            return 0
        if tag in MARKED_TAGS or (tag == "header" and not (self.open["article"] or self.open["main"])):
            return 2
        level = int(tag == "form")
        for name, value in attrs:
            if name == "role" and (value or "").lower() in MARKED_ROLES:
                return 2
            if name in ("class", "id") and value:
                own = [_name_words(v) for v in value.split()]
                marking = [w for w in own if self._marks_other(w)]
                if any(w & ANSWER_WORDS for w in marking):
                    return 2
                if marking and not any(w & ARTICLE_WORDS and not w & MARKED_WORDS for w in own):
                    level = 1
        return level

    def _marks_other(self, words: set[str]) -> bool:
        """Whether the words of one class or id name something beside the article."""
        marks = words & MARKED_WORDS
        if not marks or words & LAYOUT_WORDS or (words & ARTICLE_WORDS and not marks & ANSWER_WORDS):
            return False
        return not (marks <= HEAD_WORDS and ("post" in words or self.open["article"] or self.open["main"]))

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            last = self.stack.pop()
            self.open[last.tag] -= 1
            self.dropping -= last.dropped
            if last.element != self.stack[-1].element:
                self.elements[last.element].end = len(self.elements) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in IMPLIED_END or tag in BLOCKS:
            ends = IMPLIED_END.get(tag, ("p",))
            if any(self.open[t] for t in ends):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in ends:
                        self._pop_to(i)
                        break
                    if self.stack[i].tag in CONTAINERS or self.stack[i].dropped:
                        break
        dropped = tag in DROPPED or any(name == "hidden" for name, _ in attrs)
        marked = self._mark(tag, attrs) if not dropped and (attrs or tag in MARKED_TAGS or tag in ("header", "form")) else 0
        if tag not in KNOWN and not dropped and not marked:
            return
        element = self.stack[-1].element
        if tag in CONTAINERS or marked:
            self.elements.append(Element(tag, element, marked))
            element = len(self.elements) - 1
        self.stack.append(_Open(tag, element, dropped))
        self.open[tag] += 1
        self.dropping += dropped

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self.parts.append(" ")
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self._pop_to(i)
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.parts.append(data)

    def finish(self) -> None:
        self.ends.clear()  # the page is only its unparsed rest now
        self.close()
        self._flush()
        self._pop_to(1)
        self.elements[0].end = len(self.elements) - 1


def smoothed(values: np.ndarray, known: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over the values that are known, the kernel renormalised; a value without a known one in reach stays as it is."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(np.column_stack([values * known, known.astype(float)]), ((reach, reach), (0, 0)))
    total = sum(w * padded[i : i + len(values)] for i, w in enumerate(kernel))
    return np.where(total[:, 1] > 0, total[:, 0] / np.where(total[:, 1] > 0, total[:, 1], 1.0), values)


def split_level(values: np.ndarray) -> float:
    """Threshold between two clusters of values: two-means on a line. All values alike: below all of them."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return low - 1
    for _ in range(64):
        over = values >= (low + high) / 2
        new = float(values[~over].mean()), float(values[over].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _sums(elements: Sequence[Element], at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every element the sum of the values of the lines inside it. ``at``: the lines' elements."""
    total = np.bincount(at, weights=values, minlength=len(elements)).tolist()
    for n in range(len(elements) - 1, 0, -1):  # children come after their parents
        total[elements[n].parent] += total[n]
    return np.array(total)


def worths(lines: Sequence[Line], elements: Sequence[Element]) -> np.ndarray:
    """Smoothed logarithms of the text-to-tag ratios over the level between their clusters, less what marked elements cost."""
    at = np.array([line.element for line in lines])
    chars = np.array([len(line.text) for line in lines], dtype=float)
    held = _sums(elements, at, chars)
    by_name, by_kind = np.zeros(len(elements)), np.zeros(len(elements))
    for n, e in enumerate(elements[1:], 1):
        by_name[n] = by_name[e.parent] + (NAME_PRIOR * (1 - held[n] / (held[0] + OTHER_CHARS)) if e.marked == 1 else 0.0)
        by_kind[n] = by_kind[e.parent] + (PRIOR if e.marked == 2 else 0.0)
    # A name around all lines of the page tells none of them apart.
    cost = by_kind[at] + by_name[at] - by_name[at].min()
    # Headings are short by nature: that tells nothing of them or of the lines beside them.
    heading = np.array([line.heading for line in lines])
    smooth = smoothed(np.log1p(chars / np.maximum([line.tags for line in lines], 1)), ~heading)
    over = smooth - min(split_level(smooth), math.log1p(TEXT_RATIO))
    return np.where(heading, np.maximum(over, 0.0), over) - cost


def _undivided(elements: Sequence[Element]) -> list[bool]:
    """Whether an element may be a region of its own: a section of an article is a part of it, and one of a main element unless it is an article."""
    inside = [""] * len(elements)  # the nearest of article and main around it
    for n, e in enumerate(elements[1:], 1):
        around = elements[e.parent].tag
        inside[n] = around if around in ("article", "main") else inside[e.parent]
    return [i == "" or (i == "main" and e.tag == "article") for i, e in zip(inside, elements, strict=True)]


def select(lines: Sequence[Line], elements: Sequence[Element]) -> np.ndarray:
    """Which lines belong to the content region."""
    at = np.array([line.element for line in lines])
    chars = np.array([len(line.text) for line in lines], dtype=float)
    worth = worths(lines, elements)
    held = _sums(elements, at, chars)
    # A marked element that is worth nothing counts nothing for the elements around it, and is left out.
    out = np.zeros(len(elements), dtype=bool)
    value = np.bincount(at, weights=worth, minlength=len(elements)).tolist()
    for n in range(len(elements) - 1, 0, -1):  # children come after their parents
        if value[n] < 0 and (elements[n].marked == 2 or (elements[n].marked and held[n] < held[0])):
            out[n] = True
        else:
            value[elements[n].parent] += value[n]
    for n in range(1, len(elements)):
        out[n] |= out[elements[n].parent]
    upper = _sums(elements, at, np.where((worth >= 0) & ~out[at], chars, 0.0))
    # Every element with more than half of the upper text lies around the next one.
    whole = _undivided(elements)
    path = [n for n, e in enumerate(elements) if n == 0 or (not out[n] and whole[n] and e.tag in REGIONS and 2 * upper[n] > upper[0])]
    root = max(path, key=lambda n: (round(value[n] - value[path[-1]], 9), n))
    return ~out[at] & (at >= root) & (at <= elements[root].end)


def _parsed(html: str) -> LineParser:
    try:
        parser = LineParser()
        parser.feed(html)
        parser.finish()
    except AssertionError:  # the parser's answer to some broken declarations
        parser = LineParser()
        parser.feed(html.replace("<![", "<! ["))
        parser.finish()
    return parser


def extract(html: str | None) -> str:
    """Main text of a page: its article's blocks, one a line."""
    if not html:
        return ""
    # A tag that is cut off at the end of the page is no text, and the parser would try it at every sign of it.
    if cut := _TAG_START.search(html, html.rfind(">") + 1):
        html = html[: cut.start()]
    parser = _parsed(html)
    if not parser.lines:
        return ""
    kept = select(parser.lines, parser.elements).tolist()
    if not any(kept):
        return ""
    if not any(k and line.title for k, line in zip(kept, parser.lines, strict=True)):
        # The page's title stands before its content region and belongs to the article.
        first = kept.index(True)
        around = {line.element for line in parser.lines[:first] if line.title}
        unmarked = {n for n in around if not _is_marked(parser.elements, n)}
        kept = [k or (line.title and i < first and line.element in unmarked) for i, (k, line) in enumerate(zip(kept, parser.lines, strict=True))]
    return "\n".join(line.text for k, line in zip(kept, parser.lines, strict=True) if k)


def _is_marked(elements: Sequence[Element], n: int) -> bool:
    while n >= 0:
        if elements[n].marked:
            return True
        n = elements[n].parent
    return False


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    fields = [pages.schema[id_col], pages.schema[url_col]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), texts], names=["id", "url", "text"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ddl = f"id {fields[0].dataType.simpleString()}, url {fields[1].dataType.simpleString()}, text string"
    return spread(chosen).mapInArrow(run, ddl).toDF(id_col, url_col, "text")
