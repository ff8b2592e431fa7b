"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, clustering.

1. A page is streamed through the standard library's parser. Its events fill lines:
   a line is the text between two block boundaries and knows its tags, its link text
   and the sections (article, main, div, ...) that are open around it.
2. Each line gets the ratio of its text outside links to its tags.
3. The ratios are smoothed with a Gaussian over neighbouring lines, so a short
   paragraph between long ones keeps up and a lone long line sinks.
4. Two clusters of the smoothed ratios (1-dimensional 2-means) set the threshold. The
   lines above it vote by their text for the innermost section that holds nearly all
   of that text. The content region is the outermost article around that section, or
   main where there is no article, or else the innermost section that holds all lines
   above the threshold; all lines of the region are the text.

Menus, page headers, footers, sidebars, notices, adverts, forms, reader comments,
scripts, styles and hidden parts never become lines: they are known by element, role,
or the words of their class and id. A name counts in full only if all of its words are of
this kind or neutral (not ``related-work`` or ``social-impact``); with other words beside
them the element's text-to-tag ratio decides: it goes if the mean ratio of its text lies
below the threshold. The same holds inside an article or the main part for words that can
also mean content (``header``, ``menu``, ``notice``, ...); there only block elements that
are no headings, code or quotes are judged by names at all.

A form that holds the article, or a form, header or element of an ambiguous name that holds
more than half of all text outside links, is the page and not a part of it: such a page is
read again without skipping it. Menus, sidebars, footers, comments and adverts stay out
even where nothing else is left.

Defined cases: null, empty and text-free pages have an empty text; repeated rows are read
alike, a row each; an empty table gives no rows; very long pages are read whole, in time in
proportion to their length; broken markup does not stop a page: an unknown section of
``<![`` is a comment to the next ``>``, a comment without end goes to the end of the page, and so
does a tag without ``>``; character references are decoded; white space inside a block is one
space; blocks are joined by one line break. Of several articles on a page those stay that
share the region; a short one beside a long one counts as a teaser.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

SIGMA = 1.5
#: Share of the voting text that the region must hold.
REGION_SHARE = 0.9
#: Sections inside deeper ones count as their parents.
MAX_DEPTH = 200
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("html body article main section div td".split())
SKIPPED = frozenset("script style noscript template head title button select option textarea svg canvas iframe object audio video".split())
#: Elements that go unless they hold the page.
PARTS = frozenset("nav aside footer form menu dialog".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these the words that inside an article tell of nothing but themselves.
SURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus newsletter navbar pager pagination promo promotion replies respond sharing sidebar signup sponsor sponsored subscribe".split()
)
#: Words before ``header`` that tell of the article's own.
OWN_HEADERS = frozenset("article content entry post story title".split())
#: Words that begin like ``comment`` and mean something else.
COMMENTARY = frozenset("commentary commentaries commentator commented".split())
#: Words that add nothing to a name.
NEUTRAL_WORDS = frozenset(
    "a all area articles bar block body bottom box button buttons center class col column container content count element entry first footer form frame global google grid group header heading icon icons id inline inner item items last layout left level link links list main message mid middle module my nav net new outer page panel part post posts primary right row secondary section side site slot small stories sub text thread title top ui unit user view wrap wrapper area-1 js".split()
)
#: Elements that a name inside an article can take out; headings, code, quotes and inline elements it cannot.
NAMED = frozenset("section div ul ol dl p table tr td figure details summary center address header main".split())
#: Class names such as has-sidebar tell of the page's layout, not of the element.
LAYOUT_WORDS = frozenset("has with without no".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MARKUP = re.compile("<[a-zA-Z/!?]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def name_words(name: str) -> set[str]:
    """The words of a class or id, in lower case; ``commentlist`` and its like are comments."""
    words = {w.lower() for w in _NAME.findall(name)}
    return {"comments" if w.startswith("comment") and w not in COMMENTARY else w for w in words}


class Line:
    __slots__ = ("text", "linked", "tags", "path", "suspects", "block")

    def __init__(self, path: tuple[int, ...], suspects: tuple[int, ...]):
        self.block = ""  # the heading or paragraph that it is
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0
        self.path = path
        self.suspects = suspects


class Lines(HTMLParser):
    """Collects the lines of a page. ``whole`` numbers the start tags whose elements hold the page."""

    def __init__(self, whole: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.whole = whole
        self.n_starts = 0
        self.parts: list[int] = []  # start tags of the open elements that are skipped unless they hold the page
        self.held: dict[int, list] = {}  # of each its free text, whether it goes for sure, its name, whether it has an article
        self.hard = 0  # open elements that are skipped in any case
        self.kept = self.left = 0  # free text that is in lines, and that is not
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # element, number of its section or -1, whether it is skipped, whether suspect, whether a part
        self.count: Counter[str] = Counter()  # of open elements by name
        self.path: tuple[int, ...] = (0,)
        self.skipping = 0
        self.links = 0
        self.sections = 0
        self.in_article: set[int] = set()  # sections that are, or lie in, an article or the main part
        self.kind: dict[int, str] = {}  # of the sections that are an article or the main part
        self.suspects: tuple[int, ...] = ()  # open elements whose names may mean content
        self.n_suspects = 0
        self.line = Line(self.path, self.suspects)

    def _break(self) -> None:
        if self.line.text:
            self.lines.append(self.line)
        self.line = Line(self.path, self.suspects)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:  # not a section that the parser knows
            end = -1
        return end if end >= 0 else self.parse_bogus_comment(i, 0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)  # the page is fed as a whole

    def _skipped(self, tag: str, attrs: list) -> str:
        """``hard`` if an element goes, ``part`` or ``sure`` if it goes unless it holds the page, ``suspect`` if its lines decide."""
        if tag in SKIPPED:
            return "hard"
        verdict = "part" if tag in PARTS else ""
        container = tag in ("html", "body", "article", "main")
        inside = self.count["article"] + self.count["main"] > 0
        if tag == "header" and not inside:
            verdict = "part"
        for name, value in () if container else attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "hard"
            if not value:
                continue
            if name == "role" and value.lower() in SKIPPED_ROLES:
                verdict = verdict or "part"
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return "hard"
            if name in ("class", "id"):
                for token in value.split():
                    words = name_words(token)
                    told = words & SKIPPED_WORDS
                    if not told or words & LAYOUT_WORDS or (inside and tag not in NAMED):
                        continue
                    known = all(w in SKIPPED_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words)
                    if known and told & SURE_WORDS:
                        verdict = "sure"
                    elif told == {"header"} and (inside or words & OWN_HEADERS):
                        continue
                    elif inside and known or not inside and not known:
                        verdict = verdict or "suspect"
                    elif not inside:
                        verdict = "part" if verdict in ("", "suspect") else verdict
        return verdict

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if not self.skipping:
                if tag == "br":
                    self.line.text.append(" ")
                elif tag == "hr":
                    self._break()
                self.line.tags += 1
            return
        if tag == "body":
            self._close_head()
        elif tag == "p":
            self._close_p()
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close_like(tag)
        self.n_starts += 1
        verdict = self._skipped(tag, attrs)
        if verdict in ("part", "sure"):
            if self.n_starts in self.whole:
                verdict = ""
            elif not self.hard and len(self.parts) < MAX_DEPTH:
                self.held[self.n_starts] = [0, verdict == "sure" or tag in PARTS and tag != "form", tag, False]
        if tag in ("article", "main"):
            for start in self.parts:
                self.held[start][3] = True
        skipped, suspect = verdict in ("hard", "part", "sure"), verdict == "suspect" and tag in BLOCKS and not self.skipping
        number = -1
        if tag in BLOCKS and not self.skipping:
            self._break()
            if suspect:
                self.n_suspects += 1
                self.suspects = (*self.suspects, self.n_suspects)
                self.line.suspects = self.suspects
            if tag in SECTIONS and not skipped and len(self.path) < MAX_DEPTH:
                self.sections += 1
                number = self.sections
                if tag in ("article", "main") or self.path[-1] in self.in_article:
                    self.in_article.add(number)
                if tag in ("article", "main"):
                    self.kind[number] = tag
                self.path = (*self.path, number)
                self.line.path = self.path
        if tag in HEADINGS or tag == "p":
            self.line.block = tag
        self.open.append((tag, number, skipped, suspect, skipped and self.n_starts in self.held))
        self.count[tag] += 1
        if skipped:
            self.skipping += 1
            if self.n_starts in self.held:
                self.parts.append(self.n_starts)
            else:
                self.hard += 1
        elif not self.skipping:
            self.line.tags += 1
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close_to(at)
                return
            # an inline end tag without partner does not close blocks
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return

    def _close_head(self) -> None:
        if not self.count["head"]:
            return
        for at, (tag, *_) in enumerate(self.open):
            if tag == "head":
                self._close_to(at)
                return

    def _close_p(self) -> None:
        if not self.count["p"]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == "p":
                self._close_to(at)
                return
            if self.open[at][0] in BLOCKS:
                return

    def _close_like(self, tag: str) -> None:
        if not self.count[tag] and tag not in ("dd", "dt"):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag or (tag in ("dd", "dt") and self.open[at][0] in ("dd", "dt")):
                self._close_to(at)
                return
            if self.open[at][0] in ("ul", "ol", "dl", "table", "tr", "select", "menu"):
                return

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            tag, number, skipped, suspect, part = self.open.pop()
            self.count[tag] -= 1
            if skipped:
                self.skipping -= 1
                if part:
                    self.parts.pop()
                else:
                    self.hard -= 1
                continue
            if self.skipping:
                continue
            if tag in BLOCKS:
                if suspect:
                    self.suspects = self.suspects[:-1]
                self._break()
                if number >= 0:
                    self.path = self.path[:-1]
                    self.line.path = self.path
            else:
                self.line.tags += 1
                self.links -= tag == "a"

    def handle_data(self, data: str) -> None:
        if self.hard or not data:
            return
        free = 0 if self.count["a"] else len(data.strip())
        if self.skipping:
            self.left += free
            for start in self.parts:
                self.held[start][0] += free
            return
        self.kept += free
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        return self.lines

    def holding(self) -> frozenset[int]:
        """Of the skipped elements those that hold the page: a form with an article, or most of the free text where no article is left."""
        article = any(x.path[-1] in self.in_article for x in self.lines)
        most = [start for start, (free, sure, _, _) in self.held.items() if 2 * free > self.kept + self.left and not article and not sure]
        return frozenset(most) | {start for start, (_, _, tag, has) in self.held.items() if tag == "form" and has and not article}


def lines_of(html: str) -> Lines:
    """The parsed page, read again if an element that was skipped holds it."""
    last = html.rfind(">") + 1
    if open_tag := _MARKUP.search(html, last):  # nothing can close it
        html = html[: open_tag.start()]
    parser = Lines()
    parser.feed(html)
    parser.finish()
    if whole := parser.holding():
        parser = Lines(whole)
        parser.feed(html)
        parser.finish()
    return parser


def two_means(x: np.ndarray) -> float:
    """The threshold between two clusters of numbers."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = x > middle
        if not above.any() or above.all():
            break
        new = float(x[~above].mean()), float(x[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over neighbours; at the borders over those that exist."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / weight


def main_text(html: str, sigma: float = SIGMA) -> str:
    parser = lines_of(html)
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines]
    lines = [(text, x) for text, x in lines if text]
    if not lines:
        return ""
    free = np.array([max(0, len(text) - x.linked) for text, x in lines], float)
    raw = free / np.array([1 + x.tags for _, x in lines])
    ratio = smooth(raw, sigma)
    threshold = two_means(ratio) if len(lines) > 1 else 0.0
    chosen = ratio >= threshold
    doubted: dict[int, list[tuple[float, float]]] = {}
    for (_, x), r, n in zip(lines, raw, free, strict=True):
        for element in x.suspects:
            doubted.setdefault(element, []).append((r, n))
    # the mean over the text, not over the lines: a heading above a paragraph takes nothing from it
    if gone := {element for element, parts in doubted.items() if sum(r * n for r, n in parts) < threshold * sum(n for _, n in parts) or not any(n for _, n in parts)}:
        stays = np.array([gone.isdisjoint(x.suspects) for _, x in lines])
        if stays.any():
            lines, free, chosen = [x for x, s in zip(lines, stays, strict=True) if s], free[stays], chosen[stays]
    if not chosen.any():
        chosen[:] = True
    mass: dict[int, float] = {}
    votes: Counter[int] = Counter()
    depth: dict[int, int] = {}
    for (_, x), n, take in zip(lines, free, chosen, strict=True):
        if take:
            for d, section in enumerate(x.path):
                mass[section] = mass.get(section, 0) + n
                votes[section] += 1
                depth[section] = d
    total = mass.get(0, 0)
    region = max((s for s, n in mass.items() if n >= REGION_SHARE * total), key=lambda s: (depth[s], -s))
    if region in parser.in_article:
        path = next(x.path for _, x in lines if region in x.path)
        around = path[: path.index(region) + 1]
        region = min((s for s in around if s in parser.kind), key=lambda s: (parser.kind[s] != "article", around.index(s)))
    else:
        region = max((s for s, n in votes.items() if n == votes[0]), key=lambda s: depth[s])
    # outside an article a line of nothing but links is navigation, unless it is a heading or a paragraph in running text
    whole = region in parser.in_article
    running = lambda x, take: x.block in HEADINGS or (take and x.block == "p")
    out = [text for (text, x), take in zip(lines, chosen, strict=True) if region in x.path and (whole or x.linked < 0.9 * len(text) or running(x, take))]
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url and text of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def found(batch: pa.RecordBatch) -> dict:
        text = [main_text(x) for x in common.texts(batch, "html")]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text}

    return common.map_batches(rows, found, "page_id long, url string, text string")
