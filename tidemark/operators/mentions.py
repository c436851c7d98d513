"""Where a page's candidates stand in it: all of them found in one walk over its texts.

A page's versions make a trie; from each place where one could begin, the trie is walked
as far as the text goes along. A page and its candidates meet once, as one row: no text
is copied for each candidate.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V
from ..plans.tables import joined

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_EDGE = frozenset("0123456789.")
_TAG = re.compile(r"<(/?[a-z0-9]+)\b", re.IGNORECASE)
#: Characters before a mention in which its tag is looked for.
TAG_REACH = 80


class Trie:
    """Words, as nested dicts; the end of a word has its own entry at ''."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        firsts = "".join(re.escape(c) for c in sorted(self.root) if c)
        self._begin = re.compile(f"[{firsts}]") if firsts else None

    def places(self, text: str) -> dict[str, list[int]]:
        """All places of each word that stands in text, overlapping ones too, rising."""
        found: dict[str, list[int]] = defaultdict(list)
        if self._begin is None:
            return found
        root, n = self.root, len(text)
        for m in self._begin.finditer(text):
            at = start = m.start()
            node = root
            while at < n and (node := node.get(text[at])) is not None:
                at += 1
                if "" in node:
                    found[node[""]].append(start)
        return found


def apart(places: list[int], size: int) -> int:
    """How many of rising places of a word are left if none may overlap the one before."""
    count, end = 0, -1
    for at in places:
        if at >= end:
            count, end = count + 1, at + size
    return count


def tag_before(text: str, at: int, reach: int = TAG_REACH) -> str | None:
    """The name of the last tag in the reach characters before a place, with its slash if it closes; null if what stands last there isn't one.

    A tag that is begun inside another belongs to that one.
    """
    low = max(0, at - reach)
    last = text.rfind("<", low, at)
    if last < 0 or text.find(">", last, at) < 0:
        return None
    m = _TAG.search(text, max(low, text.rfind(">", low, last) + 1), at)
    return m[1].lower() if m and m.start() <= last else None


def found_in(html: str, links: str, downloads: str, seen: str, versions: list[tuple[str, str]]) -> list[dict]:
    """For each (version, bare): times, bounded, first, tag, in_links, in_downloads, in_seen."""
    low = html.translate(_LOWER)
    trie = Trie({b.translate(_LOWER) for _, b in versions if b})
    places = trie.places(low)
    others = [trie.places(t.translate(_LOWER)) for t in (links, downloads, seen)]
    # positions are of lower-cased text in full, which may be longer
    whole = html.lower()
    out = []
    for version, bare in versions:
        own = bare.translate(_LOWER)
        at, n = places.get(own, []), len(bare)
        exact = [p for p in at if html[p : p + n] == bare]
        free = [p for p in at if (not p or low[p - 1] not in _EDGE) and low[p + n : p + n + 1] not in _EDGE]
        first = (at[0] if at else -1) if whole == low else whole.find(bare.lower())
        inside = [any(t[p : p + n] == bare for p in o.get(own, ())) for t, o in zip((links, downloads, seen), others, strict=True)]
        tag = tag_before(html, exact[0]) if exact else None
        out.append({"version": version, "times": apart(exact, n), "bounded": apart(free, n), "first": first, "tag": tag, "in_links": inside[0], "in_downloads": inside[1], "in_seen": inside[2]})
    return out


_KIND = pa.list_(pa.struct([("version", pa.string()), ("times", pa.int32()), ("bounded", pa.int32()), ("first", pa.int32()), ("tag", pa.string()), ("in_links", pa.bool_()), ("in_downloads", pa.bool_()), ("in_seen", pa.bool_())]))


def mentions(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, version, times, bounded, first, tag, in_links, in_downloads, in_seen) of each distinct candidate (page_id, version).

    times: how often the version, without its v, stands in the page's html; bounded: in
    any case and not inside a longer number; first: its first place (from 0, -1 for none) in
    any case; tag: the tag that stands last before its first place, at most TAG_REACH characters,
    a closing one with its slash; in_...: whether it is in the texts links, downloads and
    seen, where pages has such columns. Null html is empty; candidates of pages that aren't
    there give no rows.
    """
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in pages.columns else F.lit("").alias(c) for c in ("html", "links", "downloads", "seen")]
    one = F.struct("version", F.coalesce(V.bare(F.col("version")), F.lit("")).alias("bare"))
    per = candidates.where("version is not null").groupBy("page_id").agg(F.sort_array(F.collect_set(one)).alias("versions"))
    rows = joined(pages.select("page_id", *texts), per, "page_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [found_in(*texts, [(v["version"], v["bare"]) for v in versions]) for *texts, versions in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _KIND)], names=["page_id", "found"])

    schema = rows.select("page_id", F.lit(None).cast("array<struct<version:string,times:int,bounded:int,first:int,tag:string,in_links:boolean,in_downloads:boolean,in_seen:boolean>>").alias("found")).schema
    return rows.mapInArrow(run, schema).select("page_id", F.explode("found").alias("x")).select("page_id", "x.*")
