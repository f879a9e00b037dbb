"""Main text of HTML pages: text-to-tag ratio per line, Gaussian smoothing, and threshold clustering of lines into regions.

The standard library's parser streams events. A line is what stands between two block tags (pages are often one line of source,
so source lines mean nothing); its ratio is its characters for each tag since the line before. Text that markup itself calls
something else than content (scripts, forms, menus, asides, elements whose role, class or id says advert, notice, comment, ...)
counts as no text. The ratios are smoothed by a Gaussian over neighbouring lines and split in two clusters; lines of the higher
one are the content regions. Short lines between and beside them (headings, one-word paragraphs) fall below any threshold, so
the regions are completed to the innermost element that holds most of their text (to the article or main element around it, if
there is one; else the headings before it belong to them). Outside an article element, where the page has one with text, ratios count a tenth.

Defined results: null, empty and textless pages give the empty text; white space (Unicode's, no-break spaces included) becomes
one space; an unfinished tag at the end of a page is markup; a comment that is never closed lasts to the end; elements left
open end with the one around them. Pages are whole however long; repeated rows each give a row; other columns are not read.
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

from .common import map_batches, text_of

#: Tags that begin or end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no content, wherever they stand.
APART = frozenset("script style noscript template head title nav footer aside form fieldset button select option optgroup textarea dialog menu iframe object svg math canvas audio video search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog status menu menubar toolbar note".split())
#: Words of class and id attributes.
NO_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments commentlist disqus respond reply replies responses cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations teaser widget toolbar pagination pager paging skip copyright disclaimer form search tags".split()
)
#: A class with one of these names what an element lacks or stands beside.
BESIDE = frozenset("has no non with without hide show free less open closed enabled disabled".split())
#: Elements that can complete a region; those of them that are the page itself.
CONTAINERS = frozenset("article main section div td center".split())
PAGE = frozenset(("", "html", "body"))
#: A block's start tag ends an open paragraph, and some end an open element of their kind.
ENDS = {tag: frozenset(["p", *kind.split()]) for kind in ("li", "dt dd", "option", "tr", "td th", "h1 h2 h3 h4 h5 h6") for tag in kind.split()}
P = frozenset(["p"])
#: Share of the regions' text that the completing element holds; weight of lines outside an article.
MOST, OUTSIDE = 0.8, 0.1
#: Gaussian over this many lines to either side.
SIGMA, REACH = 1.0, 2


def _words(value: str) -> list[str]:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).replace("-", " ").replace("_", " ").lower().split()


def says_apart(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's attributes call it hidden or something else than content."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            # An article's classes also say what it is about; the first word of all says what it is.
            for one in value.split():
                if tag == "article":
                    if NO_CONTENT.intersection(_words(one)[:1]):
                        return True
                    break
                words = _words(one)
                if NO_CONTENT.intersection(words) and not BESIDE.intersection(words):
                    return True
    return False


class _Lines(HTMLParser):
    """Collects lines and the tree of elements that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [("", 0, False, False)]  # name, node, apart, apart whatever a header around says
        self.open = Counter()
        self.parent, self.names = [-1], [""]
        self.text, self.tags, self.linked, self.links = [], 0, 0, 0
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []  # text, tags, linked characters, apart, heading, node

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            name, node, apart, _ = next(x for x in reversed(self.stack) if x[0] in BLOCKS or not x[0])
            self.lines.append((text, self.tags, min(self.linked, len(text)), apart, name in HEADINGS, node))
            self.tags = 0
        self.text, self.linked = [], 0

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self._end_line()
            ends = ENDS.get(tag, P)
            while self.stack[-1][0] in ends:
                self._pop()
        if tag in VOID:
            return
        own = bool(attrs) and tag != "header" and says_apart(tag, attrs)
        if own or self.open[tag] or tag in BLOCKS or tag in APART:
            _, above, apart, base = self.stack[-1]
            own = own or tag in APART
            if tag in HEADINGS and self.open["article"] and self.open["header"]:
                apart = base  # an article's header holds its headings
            self.parent.append(above)
            self.names.append(tag)
            self.stack.append((tag, len(self.parent) - 1, apart or own or tag == "header", base or own))
            self.open[tag] += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._end_line()
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        name, _, apart, _ = self.stack[-1]
        if apart and name not in BLOCKS:
            return  # inside a line, and none of it
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def parse_comment(self, i, report=1):
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_html_declaration(self, i):
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def read(self, html: str) -> _Lines:
        cut = re.compile("<[a-zA-Z/!?]").search(html, html.rfind(">") + 1)
        self.feed(html if cut is None or html.startswith("<!--", cut.start()) else html[: cut.start()])
        self.close()
        self._end_line()
        return self


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """The ratios weighed by a Gaussian over their neighbours; at the ends by what of it there is."""
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(ratio, kernel)[REACH:-REACH] / np.convolve(np.ones(len(ratio)), kernel)[REACH:-REACH]


def threshold(values: np.ndarray) -> float:
    """The bound between two clusters of the values' logarithms: the middle of their means, moved until it stays."""
    x = np.log1p(values)
    cut = (x.min() + x.max()) / 2
    for _ in range(50):
        high = x > cut
        if not high.any() or high.all():
            break
        before, cut = cut, (x[high].mean() + x[~high].mean()) / 2
        if abs(before - cut) < 1e-9:
            break
    return float(np.expm1(cut))


def _below(parent: list[int], marked: list[int]) -> np.ndarray:
    """Which elements are marked or inside a marked one; parents come before their children."""
    inside = np.zeros(len(parent), bool)
    inside[marked] = True
    for k in range(1, len(parent)):
        inside[k] |= inside[parent[k]]
    return inside


def _ancestor(page: _Lines, node: int, names: frozenset) -> int | None:
    while node >= 0 and page.names[node] not in names:
        node = page.parent[node]
    return node if node >= 0 else None


def content(html: str) -> list[str]:
    """The lines of the main text of a page, in page order."""
    page = _Lines().read(html)
    lines, parent = page.lines, page.parent
    if not lines:
        return []
    size = np.array([len(x[0]) for x in lines], float)
    tags, linked, apart, node = (np.array([x[k] for x in lines]) for k in (1, 2, 3, 5))
    prose = np.where(apart, 0.0, size - linked)
    if not prose.any():
        prose = np.where(apart, 0.0, size)  # nothing but links
        if not prose.any():
            return []
    in_article = _below(parent, [k for k, name in enumerate(page.names) if name == "article"])[node]
    if prose[in_article].any():
        prose = np.where(in_article, prose, OUTSIDE * prose)
    level = smoothed(prose / np.maximum(1, tags))
    region = (level >= threshold(level)) & (prose > 0)
    if not region.any():
        region = prose > 0
    # The innermost element that holds most of the regions' text, and around it the article.
    held = np.bincount(node, weights=np.where(region, prose, 0.0), minlength=len(parent))
    most = MOST * held.sum()
    for k in range(len(parent) - 1, 0, -1):
        held[parent[k]] += held[k]
    best = _ancestor(page, int(np.flatnonzero(held >= most).max()), CONTAINERS | PAGE)
    for name in ("main", "article"):
        around = _ancestor(page, best, frozenset([name]))
        best = best if around is None else around
    if page.names[best] not in PAGE:
        keep = _below(parent, [best])[node] & ~apart
    else:
        # The page itself: the regions, and prose of their elements between them.
        at = [_ancestor(page, int(k), CONTAINERS | PAGE) for k in node]
        homes = {at[k] for k in np.flatnonzero(region)}
        first, last = np.flatnonzero(region)[[0, -1]]
        keep = np.array([bool(region[k]) or (first < k < last and at[k] in homes and prose[k] > OUTSIDE * size[k] / 2) for k in range(len(lines))])
    if page.names[best] not in ("article", "main"):
        for k in range(len(lines) - 2, -1, -1):
            keep[k] |= keep[k + 1] and lines[k][4] and not apart[k]
    return [x[0] for x, k in zip(lines, keep.tolist(), strict=True) if k]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = ["\n\n".join(content(h)) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; blocks of the text are joined by two line feeds."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(pages, "html").alias("html"))
    return map_batches(rows, _extracted, "page_id long, url string, text string, n_chars long")


def op13_page_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
