"""Operator 7: main text of web pages by text-to-tag ratio.

A streaming parser turns a page into lines, one for each block element, each
with its text and the number of tags met. The ratio of the two, smoothed by a
Gaussian over the neighbouring lines, is clustered by a threshold; the lines
over it tell which element of the page holds the content: the articles if they
hold at least half of that text, else the page's main element if it does, else
the deepest element with nearly all of it. All lines of that element are taken,
but for those in menus, headers, footers, sidebars, notices, adverts, forms,
comments and the like, which are known by element, role, class or id. A form, or
an element known by class or id only, is spared as a wrapper if it holds at
least half of the text over the threshold and no article, main or first heading
stands outside it.

Character references are decoded and white space inside a block becomes one
space. Null and empty pages give an empty text; broken or cut-off markup is
read as far as it goes. Repeated rows are read each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA, THRESHOLD = 1.5, 0.5
#: Shares of the text over the threshold: of an article, a main or a wrapper, and of any other element.
MOST, NEARLY_ALL = 0.5, 0.9

# Names of elements, roles and classes of the web's own vocabulary.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas audio video map nav footer aside button select "
    "textarea input dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|promo|promotion|sponsor|sponsored|cookie|cookies|"
    r"consent|gdpr|notice|popup|modal|overlay|sidebar|side|aside|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|topbar|"
    r"header|masthead|footer|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|subscription|signup|login|pagination|pager|toolbar|skip|copyright|legal|disclaimer)(?![a-z])"
)
# Classes that tell what the page has or lacks, and headings of a content.
STATES = re.compile(r"(?:has|no|not|with|without)(?![a-z])")
OWN_HEADER = re.compile(r"(?:^|[^a-z])(?:article|entry|post|story)[^a-z]+header(?![a-z])")
# A start tag that ends an open paragraph or item of the same kind.
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "summary"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


class Lines(HTMLParser):
    """Blocks of a page in order: text, tags met, path of open elements, whether dropped for sure."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, dropped
        self.names: list[str] = []  # of each numbered element
        self.doubtful: list[int] = []  # boilerplate, unless they hold most of the page
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def line_end(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(n for _, n, _ in self.open)
            self.lines.append((text, self.tags, path, bool(self.open and self.open[-1][2])))
            self.tags = 0
        self.text.clear()

    def pop_to(self, depth: int) -> None:
        if any(tag in BLOCKS or tag in DROPPED for tag, _, _ in self.open[depth:]):
            self.line_end()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self.line_end()
        if tag in ENDS_P:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == "p":
                    self.pop_to(depth)
                    break
                if self.open[depth][0] in BLOCKS:
                    break
        if tag in SIBLINGS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in SIBLINGS[tag]:
                    self.pop_to(depth)
                    break
                if self.open[depth][0] in SCOPES[tag]:
                    break
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        dropped = bool(self.open and self.open[-1][2]) or self.is_boilerplate(tag, dict(attrs))
        if not dropped and self.is_doubtful(tag, dict(attrs)):
            self.doubtful.append(len(self.names))
        self.open.append((tag, len(self.names), dropped))
        self.names.append(tag)

    def is_boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        if re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return True
        return tag == "header" and not self.in_content()  # the page's, not that of an article

    def is_doubtful(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "article", "main", "header"):
            return False
        if tag == "form":
            return True
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            if STATES.match(name):
                continue
            kinds = [m[0] for m in BOILERPLATE.finditer(name)]
            if any(not k.endswith("header") for k in kinds) or (kinds and not OWN_HEADER.search(name) and not self.in_content()):
                return True
        return False

    def in_content(self) -> bool:
        return any(name in ("article", "main") for name, _, _ in self.open)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        """Marked sections hold no text of the page."""


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def over_threshold(lines: list, dropped: list[bool]) -> list[int]:
    free = [i for i, gone in enumerate(dropped) if not gone]
    # Ratio of characters to tags, boilerplate counting as lines without text.
    ratio = np.array([0.0 if gone else len(text) / max(1, tags) for (text, tags, _, _), gone in zip(lines, dropped, strict=True)])
    smoothed = smooth(ratio)
    return [i for i in free if smoothed[i] >= THRESHOLD * smoothed.std()] or free


def weights(lines: list, over: list[int]) -> tuple[dict[int, int], int]:
    """Characters over the threshold in each element and in all."""
    weight: dict[int, int] = {}
    for i in over:
        for number in lines[i][2]:
            weight[number] = weight.get(number, 0) + len(lines[i][0])
    return weight, sum(len(lines[i][0]) for i in over)


def left_out(page: Lines) -> list[bool]:
    """Which lines are boilerplate, once wrappers of the content are spared."""
    lines = page.lines
    sure = [line[3] for line in lines]
    if not page.doubtful or all(sure):
        return sure
    weight, whole = weights(lines, over_threshold(lines, sure))
    gone = set(page.doubtful)
    main = [i for i, line in enumerate(lines) if not sure[i] and any(page.names[n] in ("article", "main", "h1") for n in line[2])]
    for number in page.doubtful:  # outer ones before those inside
        if weight.get(number, 0) >= MOST * whole and all(number in lines[i][2] or gone.intersection(lines[i][2]) for i in main):
            gone.remove(number)
    return [out or bool(gone.intersection(line[2])) for out, line in zip(sure, lines, strict=True)]


def content_lines(page: Lines) -> list[str]:
    lines, dropped = page.lines, left_out(page)
    free = [i for i, gone in enumerate(dropped) if not gone]
    if not free:
        return []
    over = over_threshold(lines, dropped)
    weight, whole = weights(lines, over)
    for kind in ("article", "main"):
        roots = {n for n in weight if page.names[n] == kind}
        if roots and sum(len(lines[i][0]) for i in over if roots.intersection(lines[i][2])) >= MOST * whole:
            return [lines[i][0] for i in free if roots.intersection(lines[i][2])]
    full = [n for n, w in weight.items() if w >= NEARLY_ALL * whole and page.names[n] not in ("p", "li")]
    if not full:
        return [lines[i][0] for i in free]
    root = max(full)  # numbers grow with depth along a path
    return [lines[i][0] for i in free if root in lines[i][2]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.line_end()
    return "\n".join(content_lines(page))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Per row: its keys, `text` and `n_chars`, the code points of text."""
    keys = list(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(h) for h in part.column(part.schema.get_field_index(html)).to_pylist()]
                held = [part.column(part.schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*held, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"]
                )

    types = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{types}, text string, n_chars long")
