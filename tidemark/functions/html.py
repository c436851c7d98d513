"""What needs the structure of HTML, or Python's tolerance: element paths, Markdown, main text, users' patterns.

All are Arrow-batched; the parser mends pages with unclosed elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that say something of a page's structure.
SEMANTIC = frozenset("h1 h2 h3 h4 h5 h6 li p dt dd strong b em td th tr caption figcaption title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}} | {f"h{k}": {"p"} for k in range(1, 7)} | {x: {"p"} for x in ("ul", "ol", "div", "table", "section", "article")}
_SKIP = frozenset("script style head nav header footer svg noscript template".split())


class _Tree(HTMLParser):
    """A walk with the stack of open elements; ends that are left out are supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # name, text, has children

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1][0] in _CLOSES.get(tag, ()):
            self._close()
        if self.open:
            self.open[-1][2] = True
        if tag not in _VOID:
            self.open.append([tag, [], False])
        self.opened(tag, dict(attrs))

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.open:
            self.open[-1][1].append(data)
        self.said(data)

    def end(self):
        self.close()
        while self.open:
            self._close()

    def _close(self):
        self.closed(*self.open.pop())

    def opened(self, tag, attrs): ...

    def said(self, data): ...

    def closed(self, tag, text, children): ...


class _Paths(_Tree):
    def __init__(self):
        super().__init__()
        self.found: set[tuple[str, str]] = set()

    def closed(self, tag, text, children):
        own = "".join(text)
        if children or len(own) > 200 or not re.search(r"\d\.\d", own):
            return
        above = [x[0] for x in reversed(self.open) if x[0] in SEMANTIC]
        if not above and tag not in SEMANTIC:
            return
        path = ">".join([*above, tag if tag in SEMANTIC else "text"])
        self.found |= {("v" + v, path) for v in re.findall(r"v?(\d+(?:\.\d+){1,3})", own)}


class _Markdown(_Tree):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.links: list[str] = []

    def _hidden(self) -> bool:
        return any(x[0] in _SKIP for x in self.open)

    def opened(self, tag, attrs):
        if self._hidden():
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("p", "div", "ul", "ol", "table", "tr", "section", "article", "pre", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.out.append("[")

    def said(self, data):
        if not self._hidden():
            kept = any(x[0] == "pre" for x in self.open)
            self.out.append(data if kept else re.sub(r"\s+", " ", data))

    def closed(self, tag, text, children):
        if tag in _SKIP or self._hidden():
            return
        self.out.append({"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}.get(tag, ""))
        if tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "ul", "ol", "table", "section", "article", "pre", "blockquote"):
            self.out.append("\n\n")


def markdown_of(html: str | None) -> str:
    """Markdown of a page or fragment."""
    walk = _Markdown()
    walk.feed(html or "")
    walk.end()
    lines = [x.strip() for x in "".join(walk.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def paths_of(html: str | None) -> set[tuple[str, str]]:
    """(version, path) of leaves with a version: the semantic elements above, nearest first, and the leaf."""
    walk = _Paths()
    walk.feed(html or "")
    walk.end()
    return walk.found


def main_text_of(html: str | None) -> str:
    """Markdown blocks that are prose: headings, and blocks with more words outside links than inside. Our own density rule."""
    kept = []
    for block in markdown_of(html).split("\n\n"):
        plain = re.sub(r"\[[^\]]*\]\([^)]*\)", " ", block)
        linked = len(re.findall(r"\w+", block)) - len(re.findall(r"\w+", plain))
        words = len(re.findall(r"\w+", plain))
        if block.startswith("#") or (words >= 4 and words >= linked):
            kept.append(block)
    return "\n\n".join(kept).strip()


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown_of)


@F.pandas_udf(StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text_of)


@F.pandas_udf(StringType())
def by_pattern(html: pd.Series, pattern: pd.Series) -> pd.Series:
    """What a row's own pattern finds: group 1, or all if it has none; null for no match or a pattern that isn't one."""

    def one(text, p):
        try:
            m = re.search(p, text) if text and p else None
        except re.error:
            return None
        return (m[1] if m.re.groups and m[1] is not None else m[0]) if m else None

    return pd.Series([one(t, p) for t, p in zip(html, pattern, strict=True)], dtype=object)


def element_paths(pages: DataFrame) -> DataFrame:
    """(page_id, version, path)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, v, p) for i, html in zip(b["page_id"], b["html"], strict=True) for v, p in sorted(paths_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "version", "path"]).astype({"page_id": "int64"})

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, "page_id long, version string, path string")
