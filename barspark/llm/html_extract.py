"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: the text
between two block-level tags, with the tags inside it and the region it lies in.
A region is the nearest sectioning element; an article or main element is one
region. Each line has a ratio of text outside links to tags. Menus, notices,
adverts, forms and comments (by tag, role, class or id), and text beside the
article of a page that has one, have theirs lowered, never more: what a name
says can be outweighed by the text. The ratios are smoothed by a Gaussian that
stops where such a part begins or ends, and clustered by a threshold; a region
is content if it holds a line of the content cluster, and the text is that of
all lines of the content regions, in page order.

Time and memory grow in proportion to the page, however deeply it is nested and
however many of its tags, comments and sections never end; but tags in a row
whose quoted values hold ">", before a quote that nothing closes, take time with
the square of their number.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import slices

#: HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
REGIONS = frozenset("article main section div body td aside nav footer header form".split())
ARTICLE = frozenset(("article", "main"))
NEVER = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
#: What may stand in a head; any other element, or text, ends a head whose end tag is left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
APART = frozenset("nav aside footer menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
#: Words of class and id names that mark a part which is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
#: Words that mark one less surely, and those beside which they mean nothing ("story-header").
WEAK_MARKS = frozenset("header masthead related respond response responses widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CLOSES_ITSELF = frozenset("p li td th tr dd dt option".split())
_BARRIERS = REGIONS | frozenset("ul ol table tr dl blockquote".split())
#: Factors of lowered ratios, and the least lowered ratio that can be content.
STRONG, WEAK, BESIDE, LEAST_LOWERED = 0.01, 0.1, 0.1, 10.0
#: A form or a weakly marked part with this share of the page's text is the page.
PAGE_SHARE = 0.8
SIGMA, RADIUS = 1.0, 2
_KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(RADIUS + 1)]


class Line(NamedTuple):
    text: str
    tags: int
    link_chars: int
    region: int
    mark: int
    in_article: bool


class _Lines(HTMLParser):
    """Lines of one page, and its marked parts ``(parent, factor, sure)``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.marks: list[tuple[int, float, bool]] = [(0, 1.0, True)]
        # open elements: name, whether never text, region, mark, whether in an article
        self.stack: list[tuple[str, bool, int, int, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where each name is open in the stack
        self.fences: list[int] = []  # where regions are
        self.barriers: list[int] = []
        self.regions = 0
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.endless: set[str] = set()  # kinds of which a part has no end

    def _top(self) -> tuple[str, bool, int, int, bool]:
        return self.stack[-1] if self.stack else ("", False, 0, 0, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.links, *self._top()[2:]))
        self.parts, self.tags, self.links = [], 0, 0

    def parse_html_declaration(self, i: int) -> int:
        # As HTML has it, a bogus comment up to ">"; the library's parser raises on names it does not know.
        if self.rawdata.startswith("<![", i):
            if self.rawdata[i : i + 9].lower() != "<![cdata[":
                return self.parse_bogus_comment(i)
            return self._unless_endless("section", super().parse_html_declaration, i)
        return super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._unless_endless("comment", super().parse_comment, i)

    def _unless_endless(self, kind: str, parse: Callable[[int], int], i: int) -> int:
        """Where the part ends, or -1; the page is there whole, so an end that one part lacks no later one has."""
        end = -1 if kind in self.endless else parse(i)
        if end < 0:
            self.endless.add(kind)
        return end

    def read(self, html: str) -> None:
        """The whole page. All tags, comments and declarations end with ">", so what follows the last one is text."""
        end = html.rfind(">") + 1
        try:
            self.feed(html[:end])
            self.close()
        except (AssertionError, ValueError):  # an open declaration at the page's end
            pass
        if end < len(html):
            self.handle_data(unescape(html[end:]))
        self.end_line()

    def _end_head(self) -> None:
        while self.stack and self.stack[-1][0] == "head":
            self.end_line()
            self._close(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCKS:
            self.end_line()
            if tag in _CLOSES_ITSELF and (open_ := self.places[tag]) and open_[-1] >= (self.barriers[-1] if self.barriers else 0):
                self._close(open_[-1])
        else:
            self.tags += 1
        if tag in VOID:
            return
        _, never, region, mark, inside = self._top()
        factor, sure = _marked(tag, attrs, inside)
        never = never or tag in NEVER or not factor
        if 0 < factor < 1:
            self.marks.append((mark, factor, sure))
            mark = len(self.marks) - 1
        if tag in REGIONS and not inside or factor < 1:
            self.regions += 1
            region = self.regions
        at = len(self.stack)
        self.places[tag].append(at)
        if tag in REGIONS:
            self.fences.append(at)
        if tag in _BARRIERS:
            self.barriers.append(at)
        self.stack.append((tag, never, region, mark, inside or tag in ARTICLE))

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        for open_ in (self.fences, self.barriers):
            while open_ and open_[-1] >= at:
                open_.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        else:
            self.tags += 1
        if (open_ := self.places.get(tag)) and (tag in BLOCKS or not self.fences or open_[-1] > self.fences[-1]):
            self._close(open_[-1])

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self.stack and self.stack[-1][1]:
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.links += len(data.strip())


def _marked(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[float, bool]:
    """The factor of an element's ratios (0: not shown), and whether the mark is sure."""
    factor, sure = (STRONG, True) if tag in APART else (WEAK, False) if tag == "form" or tag == "header" and not in_article else (1.0, True)
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 0.0, True
        if not value:
            continue
        if name == "style" and _HIDDEN.search(value):
            return 0.0, True
        if name == "role" and value.lower() in ROLES:
            factor, sure = STRONG, True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = _WORD.findall(value.lower())
            if not MARKS.isdisjoint(words):
                factor, sure = STRONG, True
            elif factor == 1 and not WEAK_MARKS.isdisjoint(words) and CONTENT_WORDS.isdisjoint(words):
                factor, sure = WEAK, False
    return factor, sure


def page_lines(html: str) -> tuple[list[Line], list[float]]:
    """The page's lines and the factor of each one's ratio."""
    parser = _Lines()
    parser.read(html)
    lines, marks = parser.lines, parser.marks
    held = [0] * len(marks)
    for line in lines:
        held[line.mark] += len(line.text) - min(line.link_chars, len(line.text))
    for i in range(len(marks) - 1, 0, -1):
        held[marks[i][0]] += held[i]
    factors = [1.0] * len(marks)
    for i, (parent, factor, sure) in enumerate(marks[1:], 1):
        believed = sure or held[i] < PAGE_SHARE * held[0]
        factors[i] = min(factors[parent], factor) if believed else factors[parent]
    has_article = any(line.in_article for line in lines)
    return lines, [min(factors[x.mark], 1.0 if x.in_article or not has_article else BESIDE) for x in lines]


def ratios(lines: list[Line], factors: list[float]) -> list[float]:
    """Text to tags of each line, lowered by its factor; 0 where it is mostly links."""
    return [0.0 if 2 * x.link_chars > len(x.text) else factor * len(x.text) / max(1, x.tags) for x, factor in zip(lines, factors, strict=True)]


def smooth(values: list[float], factors: list[float]) -> list[float]:
    """Gaussian smoothing over the neighbours that an unbroken run of one factor reaches."""
    n, out = len(values), []
    for i in range(n):
        total, weight = values[i], 1.0
        for step in (-1, 1):
            for d in range(1, RADIUS + 1):
                j = i + step * d
                if not 0 <= j < n or factors[j] != factors[i]:
                    break
                total += _KERNEL[d] * values[j]
                weight += _KERNEL[d]
        out.append(total / weight)
    return out


def content_regions(lines: list[Line], factors: list[float]) -> set[int]:
    """Regions that hold a line of the content cluster."""
    raw = ratios(lines, factors)
    if not any(raw):
        return set()
    flat = smooth(raw, factors)
    mean = sum(flat) / len(flat)
    spread = math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat))
    # the lower of two usual thresholds, and never above the page's best own line
    threshold = min(spread, mean, max(f for f, r in zip(flat, raw, strict=True) if r))
    return {
        x.region for x, f, r, factor in zip(lines, flat, raw, factors, strict=True)
        if r and f >= (threshold if factor == 1 else max(threshold, LEAST_LOWERED))
    }


def extract(html: str | None) -> str:
    """The page's main text; empty where there is none."""
    if not html:
        return ""
    lines, factors = page_lines(html)
    content = content_regions(lines, factors)
    return " ".join(x.text for x in lines if x.region in content)


def extract_pages(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page's whole html.

    A null or empty page, or one without content, has an empty text; pages of
    any length are read whole. Character references are decoded; white space
    inside a block is one space; blocks are joined by one space. No exchange;
    repeated rows have a row each; other columns are not looked at; an empty
    table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
