"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser is fed piece by piece; its events become lines (the text between block boundaries, with
the tags met there and the text inside links). A line's ratio is its text outside links to its tags. The ratios, smoothed by a
Gaussian over neighbouring lines, fall into two clusters on a logarithmic scale, one of them around zero; the threshold between them separates content from the rest.

Content lines choose the region: from the body down, a container that holds nearly all of what its parent's content lines say takes
its place. Articles (article or main elements) with a content line are regions of their own, unless most content lies outside them. In an article
all lines come out; in any other region those from the first line that is dense itself to the last one, but for lists of
links, with the paragraphs and headings that adjoin them. Elements that say what they are (nav, footer, form, or a class or id all of whose
parts name boilerplate) are left out beforehand, unless they only do by a name and hold most of a page without an article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, SIGMA, ROUNDS = 1 << 16, 1.0, 20
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select datalist title".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset label".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CELLS = frozenset(("td", "th", "br"))
SECTIONS = frozenset(("article", "main"))
CLOSES_P = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "tr"}
#: Elements whose class, id or role is made of these parts, with or without the neutral ones below, are boilerplate.
PARTS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disqus footer gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notices notification "
    "pager pagination paywall popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar toc widget widgets complementary alert".split()
)
NEUTRAL = frozenset("area bar block bottom box card column container content global group holder inner item items left links list main outer page panel posts primary right row secondary section site slot space stories top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = HEADINGS | frozenset("p blockquote pre figcaption td th dd dt".split())
SINGLE = HEADINGS | frozenset("p pre li dt figcaption caption summary address".split())
#: A container takes its parent's place if it holds this share of its content; articles are passed over if they hold less than the other share.
NEARLY_ALL, HARDLY_ANY = 0.85, 0.2
_SPLIT = re.compile(r"[^a-z]+")


def _is_boiler(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in BOILER:
        return True
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                parts = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())) - {""}
                if parts & PARTS and parts <= PARTS | NEUTRAL:
                    return True
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    block: str  # the innermost block's tag
    container: int  # its number; 0 is the page
    section: int  # the outermost article's number, or 0
    hint: int  # the outermost boilerplate element's number, or 0


class Lines(HTMLParser):
    """Collects lines, and each container's parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, str, int]] = []  # tag, what it means: h(idden), b(oilerplate), s(ection) or nothing; the container's number
        self.parents, self.kinds = [0], ["body"]
        self.soft: set[int] = set()  # boilerplate by name only
        self.hidden = self.links = 0
        self.hints: list[int] = []
        self.sections: list[int] = []
        self.text: list[str] = []
        self.linked = self.tags = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                block, container = next(((t, n) for t, _, n in reversed(self.stack) if n), ("body", 0))
                self.lines.append(Line(text, self.tags, self.linked, block, container, self.sections[0] if self.sections else 0, self.hints[0] if self.hints else 0))
                self.tags = 0
            self.text, self.linked = [], 0

    def _pop(self) -> None:
        tag, what, _ = self.stack.pop()
        self.hidden -= what == "h"
        self.links -= tag == "a"
        if what == "b":
            self.hints.pop()
        if what == "s":
            self.sections.pop()

    def _number(self, tag: str) -> int:
        self.parents.append(next((n for _, _, n in reversed(self.stack) if n), 0))
        self.kinds.append(tag)
        return len(self.parents) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in CELLS:
            self.text.append(" ")
        self.tags += 1
        if tag in CLOSES_P or tag in SECTIONS:
            self._close("p", BLOCKS - {"p"})
        if tag == "li":
            self._close("li", frozenset(("ul", "ol", "menu")))
        if tag == "body":
            while self.stack and any(t == "head" for t, _, _ in self.stack):
                self._pop()
        if tag in SECTIONS and self.hints and not any(t == "aside" for t, _, _ in self.stack):
            while self.hints and any(t in ("nav", "header", "menu", "form") for t, w, _ in self.stack if w == "b"):  # one that was never closed
                self._pop()
        if tag in VOID:
            return
        number = 0
        if tag in BLOCKS or tag in ("td", "th"):
            number = self._number(tag)
        what = "h" if tag in HIDDEN else "s" if tag in SECTIONS and not self.hints else "b" if _is_boiler(tag, attrs) else ""
        self.hidden += what == "h"
        self.links += tag == "a"
        if what == "b":
            number = number or self._number(tag)
            self.hints.append(number)
            if tag not in BOILER:
                self.soft.add(number)
        if what == "s":
            self.sections.append(number)
        self.stack.append((tag, what, number))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, fence: frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in fence:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in CELLS:
            self.text.append(" ")
        self.tags += 1
        if tag not in VOID:
            self._close(tag, frozenset() if tag in BLOCKS or tag in HIDDEN else BLOCKS)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:  # a CDATA section in HTML is a comment
        return


def lines_of(html: str) -> Lines:
    """The parser with the page's lines, and each container's parent and tag."""
    parser = Lines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    parser.flush()
    return parser


def ratios(lines: list[Line]) -> np.ndarray:
    """Each line's text outside links for each of its tags, on a logarithmic scale."""
    return np.log1p(np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], float))


def smoothed(ratio: np.ndarray) -> np.ndarray:
    return np.log1p(np.convolve(np.pad(np.expm1(ratio), 3, "edge"), _KERNEL / _KERNEL.sum(), "valid"))


def threshold(x: np.ndarray) -> float:
    """Between two clusters: one around zero, which stays there, as text that isn't content hardly has a ratio, and one around the mean of what is nearer to it."""
    high = x.max()
    for _ in range(ROUNDS):
        mean = x[x >= high / 2].mean()
        if mean == high:
            break
        high = mean
    return high / 2


def region(lines: list[Line], parents: list[int], kinds: list[str], content: np.ndarray) -> int:
    """The smallest container that holds nearly all the text of its parent's content lines, from the page down; a paragraph is none."""
    weight = [0] * len(parents)
    for line, good in zip(lines, content, strict=True):
        if good:
            weight[line.container] += len(line.text)
    for n in range(len(parents) - 1, 0, -1):  # children have larger numbers than parents
        weight[parents[n]] += weight[n]
    children: dict[int, list[int]] = {}
    for n in range(1, len(parents)):
        if kinds[n] not in SINGLE:
            children.setdefault(parents[n], []).append(n)
    at = 0
    while below := [n for n in children.get(at, ()) if weight[n] >= NEARLY_ALL * max(1, weight[at])]:
        at = below[0]
    return at


def within(parents: list[int], at: int) -> list[bool]:
    """For each container whether it is `at` or inside it."""
    out = [False] * len(parents)
    out[at] = True
    for n in range(1, len(parents)):
        out[n] = out[n] or out[parents[n]]
    return out


def link_lists(lines: list[Line], parents: list[int]) -> set[int]:
    """Containers of two or more lines that are all links, and single lines that are."""
    only = [2 * x.linked > len(x.text) for x in lines]
    total, linked = [0] * len(parents), [0] * len(parents)
    for x, yes in zip(lines, only, strict=True):
        total[x.container] += 1
        linked[x.container] += yes
    for n in range(len(parents) - 1, 0, -1):
        total[parents[n]] += total[n]
        linked[parents[n]] += linked[n]
    return {n for n in range(len(parents)) if total[n] and total[n] == linked[n]}


def main_text(html: str) -> str:
    """The page's main text: blocks joined by blank lines; empty if there is none."""
    page = lines_of(html)
    lines, parents = page.lines, page.parents
    sections = any(x.section and not x.hint for x in lines)
    if not sections:  # an element that holds most of the page is no boilerplate, whatever it says
        most: dict[int, int] = {}
        for x in lines:
            most[x.hint] = most.get(x.hint, 0) + len(x.text) - x.linked
        whole = sum(most.values())
        lines = [x._replace(hint=0) if x.hint in page.soft and 2 * most[x.hint] > whole else x for x in lines]
    lines = [x for x in lines if not x.hint]
    if not lines:
        return ""
    ratio = ratios(lines)
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    content = smooth >= cut
    if sections:
        inside = np.array([bool(x.section) for x in lines])
        size = np.array([len(x.text) for x in lines])
        alone = len({x.section for x in lines if x.section}) == 1
        if not (size[content & inside].sum() < HARDLY_ANY * size[content].sum() and (content & ~inside).sum() > 2):
            chosen = {x.section for x, good in zip(lines, content, strict=True) if x.section and (good or alone)}
            chosen = chosen or {x.section for x in lines if x.section}
            return "\n\n".join(x.text for x in lines if x.section in chosen)
    inner, menus = within(parents, region(lines, parents, page.kinds, content)), link_lists(lines, parents)
    mine = [k for k, x in enumerate(lines) if inner[x.container] and not (2 * x.linked > len(x.text) and (x.container in menus or x.block == "li"))]
    dense = [k for k in mine if content[k] and ratio[k] >= threshold(ratio)] or mine
    if not dense:
        return ""
    first, last = dense[0], dense[-1]
    kept = [k for k in mine if first <= k <= last or lines[k].block in PROSE]
    return "\n\n".join(lines[k].text for k in kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points). One pass, no shuffle.

    Null and empty pages, and pages without content, have empty texts. Rows that repeat come back as often; other columns are ignored.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = src.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
