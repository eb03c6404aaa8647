"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events into lines, one per block of text, each with the tags met
on it and the containers (article, main, section, div, table cell) around it. Scripts, styles and the like have no
text. A line's ratio is its unlinked text over its tags, smoothed by a Gaussian over the lines next to it; a line
of a menu, footer, side bar, form, notice, advert or comment has ratio zero, by its element or by a class, id or
role that marks it. A threshold between the two clusters of ratios tells content lines from the rest, and they
select the content regions: articles where most of the content is in articles, else the smallest container of the
content lines without those of its containers that have none. A region keeps its short lines, too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NO_TEXT = frozenset("audio button canvas datalist embed head iframe input map noframes noscript object option script select style svg template textarea title video".split())
NOISE = frozenset("aside footer menu nav search".split())
#: Elements that are no part of the article unless they hold it (a form may be around a whole page).
DOUBTFUL = frozenset("dialog fieldset form header label".split())
CONTAINER = frozenset("article body main section div td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark an element as no part of the article.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies copyright disqus gdpr newsletter promo promoted promotion related replies reply respond sharing sponsor sponsored sponsors".split())
#: Words that often stand in the names of wrappers and headings as well.
WEAK_WORDS = frozenset("alert banner bar byline consent dialog footer header hidden legal login masthead menu meta modal nav navbar navigation navi notice notices notification pager pagination popup search share sidebar sidenav signup social subscribe subscription tags teaser toc toolbar topbar widget widgets".split())
#: Elements whose end may be left out, and the starts that imply it.
IMPLIED = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
INLINE_TAGS_THAT_SPACE = frozenset(["br", "hr", "img", "wbr"])
WORD = re.compile(r"[a-z]+")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    #: Whether it is in an element that never has the article, the innermost mark (doubtful element) and container around it.
    noise: bool
    mark: int
    container: int
    heading: bool

    @property
    def own(self) -> int:
        return len(self.text) - self.linked


class Open(NamedTuple):
    tag: str
    no_text: bool = False
    link: bool = False
    noise: bool = False
    mark: int = 0
    container: int = 0
    heading: bool = False
    #: Places in the list of open elements of the last block, and of the last one that no left-out end can close.
    block: int = 0
    stop: int = 0


class Container(NamedTuple):
    """A container with the one around it, the innermost mark around it, and the outermost articles that it is or is in."""

    tag: str
    parent: int = 0
    mark: int = 0
    article: int = 0
    main: int = 0
    #: The outermost one of either kind.
    body: int = 0


class Mark(NamedTuple):
    """A mark with the one around it, whether it is a weak one, and the outermost article or main part around it."""

    parent: int = 0
    weak: bool = False
    body: int = 0


class Lines(HTMLParser):
    """Events to lines. Containers and marks know what is around them, so an event costs the same at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = [Open("")]
        self.places: dict[str, list[int]] = {}  # of each element among the open ones
        self.lines: list[Line] = []
        self.containers: list[Container] = [Container("page")]
        self.marks: list[Mark] = [Mark()]
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.text and (text := " ".join("".join(self.text).split())):
            top = self.open[-1]
            self.lines.append(Line(text, self.tags, self.linked, top.noise, top.mark, top.container, top.heading))
            self.tags = self.linked = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            elif tag in INLINE_TAGS_THAT_SPACE and tag != "wbr":
                self.text.append(" ")
            return
        if tag in BLOCK:
            self.end_line()
            self._imply(tag)
        top = self.open[-1]
        said, mark, container = self._marked(tag, attrs), top.mark, top.container
        main, around = any(k == "role" and v == "main" for k, v in attrs), self.containers[top.container]
        if said in ("strong", "weak") or tag in DOUBTFUL and not (tag == "header" and around.body):
            self.marks.append(Mark(mark, said != "strong", around.body))
            mark = len(self.marks) - 1
        if tag in CONTAINER or main:
            kind, own = "main" if main else tag, len(self.containers)
            first = lambda kinds, before: before or (own if kind in kinds else 0)
            self.containers.append(Container(kind, container, mark, first(("article",), around.article), first(("main",), around.main), first(("article", "main"), around.body)))
            container = own
        no_text, at = top.no_text or tag in NO_TEXT or said == "hidden", len(self.open)
        block = at if tag in BLOCK else top.block
        stop = at if tag in BLOCK and tag not in IMPLIED else top.stop
        self.open.append(Open(tag, no_text, top.link or tag == "a", top.noise or tag in NOISE, mark, container, top.heading or tag in HEADING, block, stop))
        self.places.setdefault(tag, []).append(at)

    def _close(self, at: int) -> None:
        """Close the element at a place and all in it."""
        for gone in reversed(self.open[at:]):
            self.places[gone.tag].pop()
        del self.open[at:]

    def _imply(self, tag: str) -> None:
        last = max((self.places[name][-1] for name, starts in IMPLIED.items() if tag in starts and self.places.get(name)), default=0)
        if last > self.open[-1].stop:
            self._close(last)

    @staticmethod
    def _marked(tag: str, attrs: list) -> str:
        if tag in ("html", "body", "article", "main"):
            return ""
        mark = ""
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return "hidden"
            if value and name in ("class", "id", "role"):
                words = WORD.findall(value.lower())
                if not STRONG_WORDS.isdisjoint(words):
                    mark = "strong"
                elif not mark and tag not in HEADING and not WEAK_WORDS.isdisjoint(words):
                    mark = "weak"
        return mark

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        last = self.places.get(tag)
        if last and (tag in BLOCK or last[-1] > self.open[-1].block):
            self._close(last[-1])

    def handle_data(self, data: str) -> None:
        if not self.open[-1].no_text:
            self.text.append(data)
            self.linked += len(data) * self.open[-1].link

    def finish(self, html: str) -> list[Line]:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # a broken declaration such as <![x: read it as text
            if "<!" in html:
                self.__init__()
                return self.finish(re.sub(r"<!(?!--|doctype)", "&lt;!", html, flags=re.IGNORECASE))
            raise
        self.end_line()
        return self.lines


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing of the lines' ratios, renormalised at both ends."""
    reach = np.arange(-radius, radius + 1)
    kernel = np.exp(-(reach**2) / (2 * max(1.0, radius / 2) ** 2))
    return np.convolve(ratios, kernel, "full")[radius:-radius] / np.convolve(np.ones_like(ratios), kernel, "full")[radius:-radius]


def two_clusters(values: np.ndarray) -> float:
    """Threshold between the two clusters of values (two means, from both ends)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def threshold(ratios: np.ndarray) -> float:
    """Least ratio of a content line: between the clusters, but no more than the spread of all ratios."""
    return min(two_clusters(ratios), float(ratios.std())) if float(ratios.max()) > float(ratios.min()) else 0.0


def void_marks(parser: Lines) -> set[int]:
    """Marks that don't count, since the article is inside.

    Those with most of the page's text, where no article is elsewhere; those around the heaviest article; and inside of
    an article weak ones that have most of its text.
    """
    marks, containers = parser.marks, parser.containers
    under, bodies = [0] * len(marks), [0] * len(marks)  # text, and articles and main parts, under each mark; mark 0 is around all
    weight: dict[int, int] = {}  # text of the outermost articles and main parts
    for line in parser.lines:
        if not line.noise:
            under[line.mark] += line.own
            if body := containers[line.container].body:
                weight[body] = weight.get(body, 0) + line.own
    for c in containers:
        bodies[c.mark] += c.tag in ("article", "main")
    around = {containers[body].mark for body, own in weight.items() if own}
    for m in range(len(marks) - 1, 0, -1):
        under[marks[m].parent] += under[m]
        bodies[marks[m].parent] += bodies[m]
        if m in around:
            around.add(marks[m].parent)
    void = set()
    for m in range(1, len(marks)):
        most = 2 * under[m] > under[0] and bodies[m] == bodies[0]
        weak = marks[m].weak and (m in around or marks[m].body and 2 * under[m] > weight.get(marks[m].body, 0))
        if most or weak:
            void.add(m)
    if weight:
        m = containers[max(weight, key=lambda c: (weight[c], -c))].mark
        while m:
            void.add(m)
            m = marks[m].parent
    return void


def main_text(html: str | None) -> str:
    """The text of a page's content regions."""
    parser = Lines()
    lines = parser.finish(html or "")
    void = void_marks(parser)
    passes = [True]  # of each mark, whether it and all around it don't count
    for m, mark in enumerate(parser.marks[1:], 1):
        passes.append(m in void and passes[mark.parent])
    clear = [not line.noise and passes[line.mark] for line in lines]
    if not any(clear):
        return ""
    ratios, at = np.zeros(len(lines)), np.flatnonzero(clear)
    ratios[at] = smoothed(np.array([lines[k].own / max(1, lines[k].tags) for k in at]))
    content = ratios >= threshold(ratios)
    return " ".join(lines[k].text for k in selected(parser, lines, content, np.array(clear)))


def selected(parser: Lines, lines: list[Line], content: np.ndarray, clear: np.ndarray) -> list[int]:
    """Numbers of the lines of the content regions.

    `clear` lines are in no menu, footer and the like. The others are left out unless they are content, which a
    threshold over zero never lets them be.
    """
    some = np.flatnonzero(content)
    if not len(some):
        return np.flatnonzero(clear).tolist()
    containers = parser.containers
    outer = [containers[line.container].article or containers[line.container].main for line in lines]
    weight: dict[int, int] = {}
    for k in some.tolist():
        weight[outer[k]] = weight.get(outer[k], 0) + lines[k].own
    if 2 * weight.get(0, 0) <= sum(weight.values()) and any(outer[k] for k in some.tolist()):
        # articles: those with content, and those that are more than links
        text: dict[int, list[int]] = {}
        for k in np.flatnonzero(clear).tolist():
            text.setdefault(outer[k], [0, 0])
            text[outer[k]][0] += lines[k].own
            text[outer[k]][1] += lines[k].linked
        chosen = {c for c in weight if c} | {c for c, (own, linked) in text.items() if c and containers[c].tag == "article" and own > linked}
        return [k for k in range(len(lines)) if (outer[k] in chosen if clear[k] else content[k])]
    # the smallest container of all content lines outside of articles that have few of them
    if outer_share(weight):
        some = some[[outer[k] == 0 or 10 * weight[outer[k]] > sum(weight.values()) for k in some.tolist()]]
    # containers are numbered in the order of their starts, so those inside of one follow it up to its last
    last = list(range(len(containers)))
    for c in range(len(containers) - 1, 0, -1):
        last[containers[c].parent] = max(last[containers[c].parent], last[c])
    held = [lines[k].container for k in some.tolist()]
    root, most = min(held), max(held)
    while last[root] < most:
        root = containers[root].parent
    parts = [c for c in range(root + 1, last[root] + 1) if containers[c].parent == root]
    part = lambda c: bisect_right(parts, c)  # noqa: E731  the root's part that a container is in, 0 for the root itself
    holds = {part(c) for c in held}
    inside = [k for k, line in enumerate(lines) if root <= line.container <= last[root] and (line.container == root or part(line.container) in holds) and (clear[k] or content[k])]
    # headings right above it
    first = inside[0]
    while first and clear[first - 1] and lines[first - 1].heading and 2 * lines[first - 1].linked <= len(lines[first - 1].text):
        first -= 1
    return [*range(first, inside[0]), *inside]


def outer_share(weight: dict[int, int]) -> bool:
    """Whether content lines lie both in articles and outside of them."""
    return 0 in weight and len(weight) > 1


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Broken markup is read as browsers do where ends are left out. Repeated
    rows are read one by one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
