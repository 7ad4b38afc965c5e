"""Main text of web pages: parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. Every block element begins a new line; a line holds its text and
the number of tags met in it. The ratios (characters per tag) are smoothed with a Gaussian kernel over neighbouring
lines, and lines of at least the threshold are content. A container (the nearest enclosing article, section, div or,
outside an article, cell) that holds content lines is a content region, with its short lines too, since a one-word paragraph
or a heading between long paragraphs belongs to them. On a page with an article or main element only lines inside it are
looked at, but it is the ratios that decide which of its containers are content, there as elsewhere. Elements that
can't be article text by tag, role or class take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Width of the smoothing kernel in lines, and the threshold as a share of the ratios' standard deviation.
SIGMA, RADIUS, THRESHOLD = 1.0, 2, 1.0

# Element names of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = set("article main section div td th body blockquote".split())
CELL = {"td", "th"}
NEVER = set("head script style noscript template iframe svg math canvas object audio video nav footer aside form button select textarea menu dialog input label".split())
UNSEEN = set("script style template noscript".split())
CLOSES_P = BLOCK - {"body", "html", "option", "legend", "caption", "title", "summary"}
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}

# Words in class, id and role attributes that name what surrounds an article.
AROUND = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager share sharing social related recommended recommendations "
    "comment comments respond disqus reply replies newsletter subscribe subscription signup login footer widget copyright skip search alert tags".split()
)
AROUND_OUTSIDE = {"header", "masthead", "topbar"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[\s]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # name, left out, container, in article or main
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, container (-1: left out), in article or main
        self.text: list[str] = []
        self.place: tuple[int, bool] | None = None  # container of the line's first text, in article or main
        self.skipped = False  # whether the line met text that is left out
        self.tags = 0
        self.containers = 0

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, *self.place))
        elif self.skipped:
            self.lines.append(("", self.tags, -1, False))  # a gap between its neighbours
        self.text, self.place, self.skipped, self.tags = [], None, False, 0

    def pop_to(self, depth: int) -> None:
        del self.stack[depth:]

    def close_open(self, names: set[str], scope: set[str]) -> None:
        for d in range(len(self.stack) - 1, 0, -1):
            if self.stack[d][0] in names:
                self.pop_to(d)
            elif self.stack[d][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_open({"p"}, CONTAINER | {"table", "ul", "ol", "dl", "form", "button"})
        if tag in OWN_KIND:
            self.close_open(OWN_KIND[tag], SCOPE[tag])
        _, out, container, article = self.stack[-1]
        if tag in ("article", "main"):
            article = True
        if not out:
            out = tag in NEVER or (tag == "header" and not article) or self.around(tag, attrs, article)
        if tag in CONTAINER and not (article and tag in CELL):
            self.containers += 1
            container = self.containers
        self.stack.append((tag, out, container, article))

    def around(self, tag: str, attrs, article: bool) -> bool:
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value.lower())):
                return True
            if name in ("class", "id", "role") and value:
                words = set(_SPLIT.split(value.lower()))
                if words & AROUND or (not article and words & AROUND_OUTSIDE):
                    return True
        return False

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for d in range(len(self.stack) - 1, 0, -1):
            if self.stack[d][0] == tag:
                self.pop_to(d)
                return
            if tag not in BLOCK and self.stack[d][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        tag, out, container, article = self.stack[-1]
        if not out:
            self.text.append(data)
            if self.place is None and data.strip():
                self.place = (container, article)
        elif data.strip():
            self.skipped = True
            if tag not in UNSEEN:  # what a reader sees there parts the words around it
                self.text.append(" ")

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # HTML has no marked sections: whatever follows <![ is a bogus comment up to the next >.
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        at = [(k, i + d) for k, d in zip(kernel, range(-RADIUS, RADIUS + 1), strict=True) if 0 <= i + d < len(values)]
        out.append(sum(k * values[j] for k, j in at) / sum(k for k, _ in at))
    return out


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks joined by one line feed. A null or empty page, or one without content, gives an empty text."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    ratio = smooth([len(t) / max(1, n) if c >= 0 else 0.0 for t, n, c, _ in p.lines])
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    cut = min(THRESHOLD * spread, mean)
    lines = list(zip(p.lines, ratio, strict=True))
    inside = any(c >= 0 and article for (_, _, c, article), _ in lines)
    own = [(r, c) for (_, _, c, article), r in lines if c >= 0 and (article or not inside)]
    regions = {c for r, c in own if r >= cut} or {c for _, c in sorted(own)[-1:]}
    return "\n".join(t for (t, _, c, _), _ in lines if c in regions)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages without the html column and with text (string, never null) and n_chars (its code points).

    A null or empty page has an empty text. Repeated rows are judged each on its own, an empty table gives an empty one,
    and whole texts of any length are read. Columns of pages called text or n_chars are replaced.
    """
    from pyspark.sql import types as T

    own = [f for f in pages.schema.fields if f.name not in (html, text, "n_chars")]
    schema = T.StructType([*own, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h.as_py()) for h in b.column(html)]
            cols = [b.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=schema.names)

    return pages.select(*[f.name for f in own], html).mapInArrow(run, schema)


def html_query(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
