"""Main text of web pages.

Parser events of the standard library are turned into lines, one for each block
of a page. A line knows its text, the tags met in it, how much of it is links,
and the element it is in. The text-to-tag ratio of the lines is smoothed by a
Gaussian, and a threshold between two clusters of its logarithms tells content
lines from others. The content lines select what is kept:

- the region: the article that holds half of their text at least, else the
  innermost element that holds REGION_SHARE of it;
- if that is the whole body, what stands from its first content line (or the
  heading before it) to its last;
- of the elements in a region, not those mostly of links, nor containers at its
  edges, whose text is mostly on other lines;
- of elements whose names leave it open what they are (a story-header, a
  service-notice), those whose text is mostly on content lines.

What remains is kept whole, short lines too. Tags and names that say for sure
what is no content (scripts, forms, menus, adverts, comments) support this:
lines in such elements are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 16
SIGMA = 1.0
REGION_SHARE = 0.75

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas math head title select button textarea nav aside footer form dialog menu search datalist audio video map".split())
#: An opening tag that ends open elements of these names, unless one of the others is between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside body button div footer form header html li main nav section table td th".split())
#: Names of what is no content, as parts of a class or an id.
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|comments?|commentlist|disqus|repl(?:y|ies)|respond|reader-comments?|side-?bar|nav|navbar|navigation|navi|menus?|breadcrumbs?|footer|masthead|shar(?:e|ing)|social|newsletter|subscri\w+|signup|login|pagination|pager|toolbar|skip-link|visually-hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
#: Names that are as sure if they stand alone, and in doubt as a part of another.
ALONE = re.compile(r"(?:^|\s)(?:header|notices?|alert|banner|related|recommend\w*|widgets?|copyright|disclaimer|hidden)(?:$|\s)", re.I)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:header|notices?|alert|banner|related|recommend\w*|widgets?|copyright|disclaimer|hidden)(?:$|[\s_-])", re.I)
IN_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|sponsor\w*|promo\w*|related|repl(?:y|ies)|teaser)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that say nothing of what they hold, and lists.
PLAIN = frozenset("div section center details fieldset".split())
LISTS = frozenset("ul ol dl dir table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ARTICLE, DOUBT, REST = 1, 2, 0


class Lines(HTMLParser):
    """Collects (text, tags, length of links, element) for every block that is not dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.above, self.kind, self.tag = [-1], [REST], [""]  # of every element: the one it is in, what it is, its tag
        self.open: list[tuple[str, int, bool]] = []  # tag, element, whether dropped
        self.count: Counter = Counter()  # open elements by tag, all of them and those of the innermost scope
        self.scopes: list[Counter] = [Counter()]
        self.articles = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1] if self.open else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def dropped(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def push(self, tag: str, element: int, drop: bool) -> None:
        self.open.append((tag, element, drop))
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPE:
            self.scopes.append(Counter())
        self.articles += tag in BLOCKS and self.kind[element] == ARTICLE

    def cut(self, k: int) -> list[tuple[str, int, bool]]:
        """Ends the open elements from the k-th on."""
        gone = self.open[k:]
        for tag, element, _ in reversed(gone):
            if tag in SCOPE:
                self.scopes.pop()
            self.count[tag] -= 1
            self.scopes[-1][tag] -= 1
            self.articles -= tag in BLOCKS and self.kind[element] == ARTICLE
        del self.open[k:]
        return gone

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif not self.dropped():
                self.parts.append(" " if tag == "br" else "")
                self.tags += 1
            return
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.scopes[-1]["p"]:
                self.close_open({"p"}, SCOPE)
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        self.tags += not block
        parent = self.open[-1] if self.open else ("", 0, False)
        kind = None if parent[2] else self.kind_of(tag, attrs)
        if block:
            self.above.append(parent[1])
            self.kind.append(kind or REST)
            self.tag.append(tag)
            self.push(tag, len(self.above) - 1, kind is None)
        else:
            self.push(tag, parent[1], kind is None)

    def kind_of(self, tag, attrs) -> int | None:
        """What an element is; None if it is no content."""
        if tag in DROPPED or tag == "header" and not self.articles:
            return None
        if tag in ("html", "body", "main"):
            return ARTICLE if tag == "main" else REST
        kind = ARTICLE if tag == "article" else REST
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                own = tag == "article" or tag in HEADINGS
                if (IN_ARTICLE if own else NOT_CONTENT).search(value) or not own and ALONE.search(value):
                    return None
                if not own and DOUBTFUL.search(value):
                    kind = DOUBT
            if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return None
        return kind

    def close_open(self, tags, until) -> None:
        """Ends the innermost open elements of tags, with what is in them, up to one of until."""
        if not any(self.count[tag] for tag in tags):
            return
        cut = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                cut = k
            elif self.open[k][0] in until:
                break
        if cut is not None:
            self.flush()
            # inline elements that were open stay open, as in browsers
            kept = [x for x in self.cut(cut) if x[0] not in BLOCKS]
            parent = self.open[-1] if self.open else ("", 0, False)
            for tag, _, drop in kept:
                if not drop or parent[2]:
                    self.push(tag, parent[1], parent[2])

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br" and not self.dropped():
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        else:
            self.tags += 1
        if (self.count if tag in BLOCKS or tag in SCOPE else self.scopes[-1])[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.cut(k)
                    return

    def handle_data(self, data):
        if not self.dropped():
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def parsed(html: str) -> Lines:
    lines = Lines()
    try:
        for k in range(0, len(html), CHUNK):
            lines.feed(html[k : k + CHUNK])
        lines.close()
    except AssertionError:  # a marked section that the parser rejects: the rest is read without such sections
        lines = Lines()
        lines.feed(re.sub(r"<!\[", "&lt;![", html))
        lines.close()
    lines.flush()
    return lines


def smoothed(values: np.ndarray) -> np.ndarray:
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach:-reach]
    return np.convolve(values, kernel, "full")[reach:-reach] / weight


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters of the values (2-means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(ratio: np.ndarray) -> np.ndarray:
    """Which lines are content, by their text-to-tag ratio."""
    logs = np.log1p(smoothed(ratio))
    return logs >= threshold(logs)


def main_text(html: str | None) -> str:
    """The text of the page's main region: its blocks joined by a new line; empty for a null."""
    if not html:
        return ""
    page = parsed(html)
    if not page.lines:
        return ""
    size = np.array([len(line[0]) for line in page.lines], np.int64)
    content = content_lines(size / np.maximum(1, [line[1] for line in page.lines]))
    element = np.array([line[3] for line in page.lines])
    n = len(page.above)

    def held(amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each element: its own lines' amounts, and those with all that is in it."""
        own = np.bincount(element, amounts, n)
        every = own.copy()
        for e in range(n - 1, 0, -1):
            every[page.above[e]] += every[e]
        return own, every

    every = held(size)[1]
    own, good = held(size * content)
    gone = np.zeros(n, bool)
    for e in range(1, n):
        gone[e] = gone[page.above[e]] or page.kind[e] == DOUBT and 2 * good[e] < every[e]
    if gone.any():
        content &= ~gone[element]
        own, good = held(size * content)
    articles = [e for e in range(n) if page.kind[e] == ARTICLE and good[e] and not gone[e]]
    first, last = 0, len(content)
    if articles and (most := max(good[e] for e in articles)) * 2 >= good[0]:
        region = max(e for e in articles if good[e] == most)
    else:
        region = 0
        for e in range(1, n):
            if good[e] >= REGION_SHARE * good[0] and page.above[e] == region:
                region = e
        # a single block is too narrow: its siblings belong to the same text
        if region and good[region] == own[region]:
            region = page.above[region]
    inside = np.zeros(n, bool)
    inside[region] = True
    for e in range(region + 1, n):
        inside[e] = inside[page.above[e]] and not gone[e]
    at = np.flatnonzero(inside[element] & content)
    if not len(at):
        return ""
    links = held(np.minimum(size, [line[2] for line in page.lines]))[1]
    start, stop = at[0], at[-1] + 1
    begin, end = np.full(n, len(content)), np.zeros(n, np.int64)  # of each element: the first line in it and the one behind the last
    np.minimum.at(begin, element, np.arange(len(element)))
    np.maximum.at(end, element, np.arange(1, len(element) + 1))
    for e in range(n - 1, 0, -1):
        begin[page.above[e]] = min(begin[page.above[e]], begin[e])
        end[page.above[e]] = max(end[page.above[e]], end[e])
    for e in range(region + 1, n):
        other = inside[e] and 2 * good[e] < every[e]
        edge = end[e] <= start or begin[e] >= stop or begin[e] <= begin[region] or end[e] >= end[region]
        if other and (page.tag[e] in PLAIN | LISTS and 2 * links[e] > every[e] or page.tag[e] in PLAIN and edge):
            inside[e] = False
        inside[e] &= inside[page.above[e]]
    if page.tag[region] in ("", "html", "body"):
        heads = [k for k in range(start) if inside[element[k]] and page.tag[element[k]] in HEADINGS]
        first, last = heads[0] if heads else start, stop
    return "\n".join(page.lines[k][0] for k in range(first, last) if inside[element[k]])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages (page_id, url, html).

    A null or empty html, and one without any content, gives an empty text. Pages
    of any length are read whole, in time that grows with their length, also if
    deeply nested. Repeated rows each give a row, an empty table none; other
    columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


#: For pages as the shared tables have them: the article of plain blocks, and these four character references. It knows nothing of the method.
ORACLE_SQL = r"""
WITH bodies AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
blocks AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '(?i)</?(?:h[1-6]|p|ul|li|div|blockquote|pre|section)\b[^>]*>', chr(1), 'g'), '(?s)<!--.*?-->', '', 'g'), chr(1)) AS parts FROM bodies),
cleaned AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM blocks),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM cleaned)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
