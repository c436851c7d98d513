"""The part of a rendered page that speaks of one version: its element, found by walking up from where the version stands.

One pass over the page notes for each element where it begins and ends, in the HTML and
in the text of the page. What an element says is then a stretch of that text, and whether
it names the version, and how long it is, are lookups.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import _CLOSES, _VOID

#: Characters of a block that holds one version's notes; steps up to it; elements to begin at; characters of a title.
LEAST, MOST, STEPS, TITLE = 180, 20_000, 5, 120
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 header time div p article section".split())
_VERSION = re.compile(r"\bv?(\d+\.\d+(?:\.\d+)?)")
_UPDATED = re.compile(r"Updated\s+to\s")


class Outline(HTMLParser):
    """Elements in document order: name, id, parent (-1 for none), begin and end in the HTML, from and to in the text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.name, self.id, self.parent = html, [], [], []
        self.begin, self.end, self.frm, self.to = [], [], [], []
        self._open: list[int] = []
        self._lines, self._parts, self._size = [0], [], 0
        at = html.find("\n")
        while at >= 0:
            self._lines.append(at + 1)
            at = html.find("\n", at + 1)
        self.feed(html)
        self.close()
        while self._open:
            self._closed(len(html))
        self.text = "".join(self._parts)

    def _at(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _closed(self, end: int) -> None:
        k = self._open.pop()
        self.end[k], self.to[k] = end, self._size

    def handle_starttag(self, tag, attrs):
        at = self._at()
        while self._open and self.name[self._open[-1]] in _CLOSES.get(tag, ()):
            self._closed(at)
        self.name.append(tag)
        self.id.append(dict(attrs).get("id") or "")
        self.parent.append(self._open[-1] if self._open else -1)
        self.begin.append(at)
        self.end.append(at + len(self.get_starttag_text() or ""))
        self.frm.append(self._size)
        self.to.append(self._size)
        if tag not in _VOID:
            self._open.append(len(self.name) - 1)

    def handle_startendtag(self, tag, attrs):
        # only void elements close themselves
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self._at()
        if any(self.name[k] == tag for k in self._open):
            while self.name[self._open[-1]] != tag:
                self._closed(at)
            stop = self.html.find(">", at)
            self._closed(stop + 1 if stop >= 0 else len(self.html))

    def handle_data(self, data):
        self._parts.append(data)
        self._size += len(data)


class _Said:
    """Whether a word is in the text of an element."""

    def __init__(self, page: Outline, places: list[int], sizes: list[int]):
        self.page, self.places, self.sizes = page, places, sizes

    def __call__(self, k: int) -> bool:
        i = bisect.bisect_left(self.places, self.page.frm[k])
        return i < len(self.places) and self.places[i] + self.sizes[i] <= self.page.to[k]


def _places(text: str, word: str) -> list[int]:
    found, at = [], text.find(word)
    while at >= 0:
        found.append(at)
        at = text.find(word, at + 1)
    return found


def version_block(html: str | None, target: str | None) -> tuple[str, str | None] | None:
    """(html, title) of the element that holds a version's notes; null if the page has none.

    In order: the element of that id; the article around an element whose id holds the
    version; of the blocks around notes that something was updated to it, the longest; the
    first block around the first element that names it, or that element. A block is one of
    up to STEPS ancestors with LEAST to MOST characters that names the version. Without a
    target: the parent of the first element with a version.
    """
    if not html:
        return None
    page = Outline(html)
    wanted = re.sub(r"\+.*$", "", re.sub("^[vV]", "", target or ""), flags=re.S)
    size = lambda k: page.to[k] - page.frm[k]
    titled = lambda k: page.text[page.frm[k] : page.to[k]].strip()[:TITLE] or None
    block = lambda k, title: (page.html[page.begin[k] : page.end[k]], title)
    every = range(len(page.name))
    if not wanted:
        # two digits around a point come first: only where they are, an element's own text is searched
        points = [x.start() for x in re.finditer(r"(?=\d\.\d)", page.text)]
        has = _Said(page, points, [3] * len(points))
        first = next((k for k in every if page.name[k] in ANCHORS and has(k) and _VERSION.search(page.text[page.frm[k] : page.to[k]])), None)
        return None if first is None else block(page.parent[first] if page.parent[first] >= 0 else first, titled(first))
    for own in (f"v{wanted}", wanted):
        k = next((k for k in every if page.id[k] == own), None)
        if k is not None:
            return block(k, titled(k))
    for k in every:
        if wanted in page.id[k]:
            while k >= 0 and page.name[k] != "article":
                k = page.parent[k]
            if k >= 0:
                return block(k, titled(k))
    places = _places(page.text, wanted)
    names = _Said(page, places, [len(wanted)] * len(places))
    noted = list(_UPDATED.finditer(page.text))
    updated = _Said(page, [x.start() for x in noted], [x.end() - x.start() for x in noted])

    def above(k: int):
        for _ in range(STEPS):
            k = page.parent[k]
            if k < 0:
                return
            if LEAST <= size(k) <= MOST and names(k):
                yield k

    blocks = [j for k in every if page.name[k] == "div" and updated(k) and names(k) for j in above(k)] if noted else []
    if blocks:
        # of equal ones the first that was met
        best = max(blocks, key=size)
        return block(best, page.text[page.frm[best] : page.to[best]][:TITLE])
    first = next((k for k in every if page.name[k] in ANCHORS and names(k)), None)
    return None if first is None else block(next(above(first), first), titled(first))


def located(pages: DataFrame, html: str = "rendered") -> DataFrame:
    """pages with block (html, title): as version_block() finds it for target, else null."""
    kept = [c for c in pages.columns if c != "block"]
    own = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), F.col(html).alias("html"), "target")
    kind = pa.struct([("html", pa.string()), ("title", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [version_block(h, t) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x and {"html": x[0], "title": x[1]} for x in found], kind)], names=["row", "block"])

    found = own.mapInArrow(run, own.select("row", F.lit(None).cast("struct<html:string,title:string>").alias("block")).schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "block")
