"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line counts with the length of its text, or with zero if it lies
in boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by element or by class, id or
role) or if most of it is link text (in an article: a list item or cell of links). Sums over a sliding window of lines
show where text begins (surge) and where it ends (dive: a whole window without text); what lies between is kept, lines of
links included. The edges of article elements are dives, and boilerplate inside an article is no line at all. If text
surges inside the articles of a page, its main text is what surges there; else it is what surges outside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Lines in a window; characters in a window that make a surge.
WINDOW, SURGE = 3, 80
#: Elements that end a line. Fixed values.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text. Fixed values.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object svg canvas select button textarea dialog head title menu audio video map".split())
#: Elements whose content has no tags; without an end tag, script and style take the rest of the page. Fixed values.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
#: Elements that end where one of these begins, as their own end tags may be left out. Fixed values.
P_ENDERS = BLOCKS - frozenset("body br button caption head html legend li option select tbody td tfoot th thead title tr dd dt".split())
SIBLINGS = {name: frozenset(group.split()) for group in ("li", "dd dt", "option", "td th", "tr", "tbody thead tfoot") for name in group.split()}
#: Elements that end the search for an element to close. Fixed values.
LISTS = frozenset("ul ol menu dl table select article main body".split())
#: Words of a class, id or role that mark boilerplate, unless the word before says that something only has it. Fixed values.
MARKS = frozenset(
    "ad ads advert adverts advertise advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promotion promoted cookie cookies consent gdpr notice notices alert alerts"
    " sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs toc tableofcontents footer header masthead contentinfo complementary search comment comments commentlist disqus respond share"
    " sharing social related recommended newsletter subscribe signup popup modal overlay widget widgets toolbar pagination pager copyright".split()
)
#: Those that may name the layout of a whole page.
LAYOUT = frozenset("sidebar sidebars menu menus nav navbar navigation footer header masthead toolbar widget widgets search".split())
HOLDERS = frozenset("has with without no not show hide hides toggle enable".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: A comment; a tag, whose values may be quoted (a quote that isn't closed is a character); other markup.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[/!?][^>]*(?:>|\Z)""",
    re.S,
)


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # characters in links
    item: bool  # in a list item or a cell
    article: bool
    skips: tuple[int, ...]  # the boilerplate elements around it, by number


def mark(rest: str) -> str:
    """The word of boilerplate in the class, id or role among a tag's attributes, or nothing."""
    for found in ATTRIBUTE.findall(rest):
        for token in "".join(found).split():
            parts = PARTS.findall(HUMPS.sub("-", token).lower())
            for i, part in enumerate(parts):
                if part in MARKS and (not i or parts[i - 1] not in HOLDERS):
                    return part
    return ""


class Parser:
    """Lines of one page. Elements end at their end tags, at those of elements around them, or where HTML implies it."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []  # name, number of the boilerplate element or 0
        self.n_open: Counter[str] = Counter()
        self.linked = self.n_skips = 0
        self.layout: set[int] = set()  # boilerplate elements that might be of a layout after all
        self.skips: tuple[int, ...] = ()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                item = any(self.n_open[x] for x in ("li", "td", "th", "dd", "dt"))
                article = bool(self.n_open["article"] or self.n_open["main"])
                self.lines.append(Line(text, self.linked, item, article, self.skips))
        self.pieces, self.linked = [], 0

    def close(self, at: int) -> None:
        """Close the open elements from index `at` on."""
        if self.skips and any(skip for _, skip in self.open[at:]):
            self.flush()
        for name, _ in self.open[at:]:
            self.n_open[name] -= 1
        del self.open[at:]
        self.skips = tuple(skip for _, skip in self.open if skip) if self.skips else ()

    def find(self, names: frozenset[str], stops: frozenset[str]) -> int:
        """Index of the innermost open element of `names` that no element of `stops` hides, or -1."""
        if any(self.n_open[x] for x in names):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in names:
                    return i
                if self.open[i][0] in stops:
                    break
        return -1

    def start(self, name: str, rest: str) -> None:
        if name in P_ENDERS and (at := self.find(frozenset(("p",)), LISTS)) >= 0:
            self.close(at)
        if name in SIBLINGS and (at := self.find(SIBLINGS[name], LISTS)) >= 0:
            self.close(at)
        if name == "body" and self.n_open["head"]:
            self.close(self.find(frozenset(("head",)), frozenset()))
        if name in ("article", "main") and not self.n_open["article"] and self.skips:
            # what holds the article is no boilerplate, unless its element says so
            self.open = [(x, skip if x in DROPPED and x not in ("form", "header", "menu", "dialog") else 0) for x, skip in self.open]
            self.skips = tuple(skip for _, skip in self.open if skip)
        if name in VOID or rest.endswith("/"):
            return
        skip, inner = 0, self.n_open["article"] > 0
        if name not in ("html", "body", "main") and (name != "article" or inner):
            # inside two of them, one more changes nothing
            word = mark(rest) if rest else ""
            if len(self.skips) < 2 and (name in DROPPED or word or HIDDEN.search(rest)):
                self.n_skips += 1
                skip = self.n_skips
                if name == "form" or name not in DROPPED and word in LAYOUT:
                    self.layout.add(skip)
                self.flush()
                self.skips = (*self.skips, skip)
        self.open.append((name, skip))
        self.n_open[name] += 1

    def end(self, name: str) -> None:
        stops = frozenset() if name in ("article", "main", "body", "html") else frozenset(("article", "main", "body")) if name in ("div", "section", "span", "p", "a") else frozenset(("body",))
        if self.n_open[name] and (at := self.find(frozenset((name,)), stops)) >= 0:
            self.close(at)

    def run(self, page: str) -> list[Line]:
        at, unclosed = 0, set()
        while m := TAG.search(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name in BLOCKS:
                self.flush()
            if m["end"]:
                self.end(name)
                continue
            if name in RAW and not m["rest"].endswith("/"):
                stop = None if name in unclosed else RAW[name].search(page, at)
                if stop:
                    at = stop.end()
                else:
                    unclosed.add(name)
                    at = len(page) if name in ("script", "style") else at
                continue
            self.start(name, m["rest"])
        if at < len(page):
            self.text(page[at:])
        self.flush()
        return self.lines

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.n_open["a"]:
            self.linked += len(piece)


def surges(lengths: list[int], least: int) -> Iterator[tuple[int, int]]:
    """[start, stop) of the runs of lines between a surge, a window of `least` characters, and the dive after it."""
    n, start = len(lengths), None
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    least = min(least, max(sums, default=0))  # on a page of few words, its densest place
    for i in range(n):
        if start is None and lengths[i] and sums[i] >= least:
            start = i
        elif start is not None and not sums[i]:
            yield start, i
            start = None
    if start is not None:
        yield start, n


def length(line: Line) -> int:
    """What a line counts: its text, or nothing where most of it is links."""
    links = 2 * line.linked > len(line.text) and (line.item or not line.article)
    return 0 if line.skips or links else len(line.text)


def peak(lengths: list[int]) -> int:
    return max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)


def of_articles(lines: list[Line]) -> list[str]:
    """The texts between surge and dive in articles; a run reaches back to the last line that counts zero before it."""
    kept: list[str] = []
    section: list[Line] = []
    for line in [*lines, None]:
        if line and line.article:
            section += [] if line.skips else [line]
            continue
        if line and line.skips:  # boilerplate between two articles parts nothing
            continue
        lengths = [length(x) for x in section]
        done = 0
        for start, stop in surges(lengths, SURGE if peak(lengths) >= SURGE else 1):
            while start > done and lengths[start - 1]:
                start -= 1
            kept += [x.text for x in section[start:stop]]
            done = stop
        section = []
    return kept


def main_text(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    parser = Parser()
    lines = parser.run(page or "")
    inside = [length(x) for x in lines if x.article and not x.skips]
    outside = [0 if x.article else length(x) for x in lines]
    if any(inside) and (peak(inside) >= SURGE or peak(outside) < SURGE):
        return " ".join(of_articles(lines))
    if peak(outside) < SURGE and parser.layout:
        # text surges nowhere but in what is named like boilerplate: that name was of a layout
        mass: Counter[int] = Counter()
        for x in lines:
            if x.skips and x.skips[0] in parser.layout and not x.article:
                mass[x.skips[0]] += max(0, len(x.text) - x.linked)
        if mass and 10 * max(mass.values()) >= 9 * (sum(mass.values()) + sum(outside)):
            held = max(mass, key=lambda k: (mass[k], -k))
            for x in lines:
                x.skips = x.skips[1:] if x.skips and x.skips[0] == held else x.skips
            again = [0 if x.article else length(x) for x in lines]
            outside = again if peak(again) >= SURGE else outside
    # lines between surge and dive that are boilerplate stay out
    return " ".join(lines[i].text for start, stop in surges(outside, SURGE) for i in range(start, stop) if outside[i])


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """`pages` with the columns text and n_chars (code points) in place of `page`.

    A null or empty page, and one without main text, has an empty text. Character references are decoded once, white
    space inside a line becomes one space, and lines are joined by one space. Columns of `pages` that are named text or
    n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    keep = [f for f in pages.schema if f.name not in (page, "text", "n_chars")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars bigint"])
    return pages.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{page}`")).mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
