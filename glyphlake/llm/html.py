"""Main text of web pages from the events of the standard library's streaming parser.

Events become lines: runs of text between block-level tags, with the number of tags in them. Lines in menus, headers,
footers, sidebars, notices, adverts, forms and comments are left out by rule. The text-to-tag ratios of the others,
smoothed by a Gaussian, fall into two clusters, content and the rest, and the content region is the deepest element that
holds most of the content, or the article or main element around it. All lines of the region count, short ones too, but not
those of sections that are mostly something else.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without main text.
OUT = frozenset(
    "script style head title noscript template nav footer aside form button select textarea input iframe object svg canvas menu dialog audio video map".split()
)
#: Names in class and id that mark what is not main text, alone, at the end of a compound or before words of PARTS.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion recommendations recommended related "
    "replies reply respond search share sharing sidebar skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
PARTS = frozenset("a area b bar block body bottom box button buttons c container cta d form icon icons inner item items left link links list main outer panel right row section slot text top unit wrap wrapper".split())
OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open paragraph; of the pairs below, an open element of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article body div html main section table td ul ol dl form nav aside header footer".split())
SECTIONS = frozenset("article aside body div html main section table td".split())
#: Width of the Gaussian in lines; how many times the ratios of content are those of the rest at least, otherwise all is
#: content; and the share of the content's text that the region holds.
SIGMA, APART, SHARE = 1.0, 2.0, 0.75


@lru_cache(10_000)
def _marked(value: str) -> bool:
    """Whether a name in a class or id marks what is not main text."""
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if words and (words[-1] in OUT_NAMES or any(w in OUT_NAMES and PARTS.issuperset(words[i + 1 :]) for i, w in enumerate(words))):
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines as (text, tags, innermost element); every event takes a time that does not grow with the depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: open elements as (tag, number, out), and where in it the open elements of each tag and kind are
        self.stack: list[tuple[str, int, bool]] = []
        self.open: dict[str, list[int]] = {}
        #: element by number: the one around it, its tag; number 0 is the page
        self.parent, self.tag = [0], [""]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.stack[-1][1] if self.stack else 0))
            self.text.clear()
            self.tags = 0

    def last(self, *kinds: str) -> int:
        """The place of the innermost open element of these tags and kinds, -1 for none."""
        return max((at[-1] for kind in kinds if (at := self.open.get(kind))), default=-1)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            for kind in _kinds(self.stack.pop()[0]):
                self.open[kind].pop()

    def is_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        inside = self.last("article", "main") >= 0
        if tag in OUT or tag == "header" and not inside:
            return True
        if self.stack and self.stack[-1][0] == "header":  # in an article's header only headings are text of it
            return tag not in HEADING
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            if name == "role" and value.lower() in OUT_ROLES:
                return True
            if name in ("class", "id") and _marked(value) and not (tag in HEADING and inside):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            self.close_implied(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        # text of an element that is out is not taken; an inline one does not part its block
        out = bool(self.stack) and self.stack[-1][2] or self.is_out(tag, attrs)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.tag.append("" if out else tag)
        for kind in _kinds(tag):
            self.open.setdefault(kind, []).append(len(self.stack))
        self.stack.append((tag, len(self.tag) - 1, out))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as HTML reads it: the slash means nothing

    def close_implied(self, tag: str) -> None:
        if tag in ("article", "main", "footer", "body"):  # never inside a menu or the head: those were left open
            first = min((at[0] for kind in ("nav", "head") if (at := self.open.get(kind))), default=-1)
            if first >= 0:
                self.flush()
                self.pop_to(first)
        k = self.last("p", *SIBLINGS.get(tag, ()))
        if k >= 0 and k >= self.last(":holder"):
            self.pop_to(k)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self.tags += 1
        k = self.last(tag)
        barrier = -1 if tag in BLOCK else self.last(":block")
        if tag == "p":
            barrier = max(barrier, self.last(":container"))
        if tag not in CONTAINERS:
            barrier = max(barrier, self.last("article", "main", "body"))
        if k >= 0 and k >= barrier:  # otherwise no such element is open here
            if tag in BLOCK:
                self.flush()
            self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if self.stack and (self.stack[-1][2] or self.stack[-1][0] == "header"):
            return
        self.text.append(data)


@lru_cache(1_000)
def _kinds(tag: str) -> tuple[str, ...]:
    """Under which names an open element is found: its tag, and what it stops."""
    kinds = [tag]
    if tag in BLOCK:
        kinds.append(":block")
    if tag in CONTAINERS:
        kinds.append(":container")
    if tag in CONTAINERS or tag in ("blockquote", "li", "dd", "th", "figure"):
        kinds.append(":holder")
    return tuple(kinds)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - radius), min(len(ratios), i + radius + 1)
        weights = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi], strict=True)) / sum(weights))
    return out


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by newlines; empty for null, empty or textless pages."""
    if not page:
        return ""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    chosen = _region(parser, lines, content_of(smoothed([len(text) / tags for text, tags, _ in lines])))
    return "\n".join(text for text, _, e in lines if chosen[e])


def content_of(ratios: list[float]) -> list[bool]:
    """Of each line whether its ratio is of the higher cluster.

    Of all ways to cut the ratios in two, on a scale of logarithms, that with the least variance inside the clusters; the
    threshold lies half way between their means. Where these are not APART there is one cluster, and all is content.
    """
    scale = [math.log1p(r) for r in ratios]
    line = sorted(scale)
    total, n, low = sum(line), len(line), 0.0
    best, threshold = -1.0, -math.inf
    for k in range(1, n):
        low += line[k - 1]
        below, above = low / k, (total - low) / (n - k)
        between = k * (n - k) * (above - below) ** 2
        if line[k] > line[k - 1] and between > best:
            best = between
            threshold = (below + above) / 2 if math.expm1(above) >= APART * math.expm1(below) else -math.inf
    return [x >= threshold for x in scale]


def _region(parser: _Lines, lines: list, content: list[bool]) -> list[bool]:
    """Of each element whether its own lines are main text. Elements are numbered from the outside in.

    The region is the deepest element with most of the content. An article around it counts, with the articles beside it
    that are content too, or else its main element; otherwise the region grows to a section, and outward while only
    headings and content of no other section stand beside it. Sections in it that are mostly not content are left out;
    of an article or main element nothing is.
    """
    n, parent, tag = len(parser.tag), parser.parent, parser.tag
    home = [0] * n  # the section that an element lies in, itself included
    for e in range(1, n):
        home[e] = e if tag[e] in SECTIONS else home[parent[e]]
    # of each element and all inside: code points, those of content, lines, lines in headings; and its own loose content
    size, own, count, heads, loose = ([0] * n for _ in range(5))
    for (text, _, e), c in zip(lines, content, strict=True):
        heading = tag[e] in HEADING
        size[e] += len(text)
        own[e] += c * len(text)
        count[e] += 1
        heads[e] += heading
        loose[home[e]] += c and not heading
    for e in range(n - 1, 0, -1):
        for sums in (size, own, count, heads):
            sums[parent[e]] += sums[e]
    mostly = [2 * own[e] >= size[e] > 0 for e in range(n)]
    region = max(e for e in range(n) if own[e] >= SHARE * own[0])

    def around(kind: str) -> int:
        e = region
        while e and tag[e] != kind:
            e = parent[e]
        return e

    article, main = around("article"), around("main")
    if article:
        roots = {e for e in range(1, n) if tag[e] == "article" and parent[e] == parent[article] and mostly[e]} | {article}
    elif main:
        roots = {main}
    else:
        region = home[region]
        while region:
            outer = home[parent[region]]
            beside = count[outer] - count[region] - (heads[outer] - heads[region]) - loose[outer]
            if beside > 0:
                break
            region = outer
        roots = {region}
    chosen = [False] * n
    for e in range(n):
        if e in roots:
            chosen[e] = True
        elif e and chosen[parent[e]]:
            chosen[e] = bool(article or main) or mostly[e] or tag[e] not in SECTIONS or not size[e]
    return chosen


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text, n_chars); one row for each row, null html as empty.

    Pages are parsed one by one, whole, with no shuffle, in a time linear in their length; memory is bounded by the
    longest page. Null ids and urls, and rows that repeat, are returned as they are; an empty table gives an empty
    result; other columns are ignored. White space inside a block becomes one space; blocks are joined by newlines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
