"""Fetching a table of URLs as a step of a plan, and the pages that pages link to.

URLs are dealt by host, hosts of many URLs in lanes; a host is asked at its own pace,
whatever else a task has to do, and what isn't due yet lets others go first. No URL
passes the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions import versions as V
from ..operators.asking import in_order
from ..plans.tables import written
from . import http, registries

#: URLs of a lane: a host of more is dealt to several tasks.
LANE = 500
#: Rows that a task looks through for one that is due; requests in flight in it.
LOOK, WINDOW = 2_000, 16
_FETCHED = "url string, status int, text string, error string"


def lanes(urls: DataFrame, per: int = LANE) -> DataFrame:
    """(url, host, lane, of): each URL once with its host and its lane, one of as many as the host has URLs for."""
    rows = urls.select("url").where("url is not null").distinct().withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^[a-z]+://([^/?#]*)", 1)), F.lit("")))
    rows = written(rows)
    many = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > per).select("host", F.ceil(F.col("n") / per).cast("int").alias("of"))
    # hosts with more than per URLs are at most 1 / per of the rows
    rows = rows.join(many, "host", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    return rows.select("url", "host", F.pmod(F.xxhash64("url"), F.col("of")).cast("int").alias("lane"), "of")


def in_turn(rows: Iterator[tuple], pace: float, look: int = LOOK, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows (url, host, of) such that those of a host come at least pace * of seconds apart; the one due first, of those looked at, goes first."""
    waiting: dict[str, list[tuple]] = {}
    due: dict[str, float] = {}
    held, more = 0, True
    while True:
        while more and held < look:
            row = next(rows, None)
            if row is None:
                more = False
                break
            waiting.setdefault(row[1], []).append(row)
            held += 1
        if not held:
            return
        host = min(waiting, key=lambda h: due.get(h, 0.0))
        now = clock()
        if due.get(host, 0.0) > now:
            sleep(due[host] - now)
            now = clock()
        row = waiting[host].pop(0)
        held -= 1
        if not waiting[host]:
            del waiting[host]
        due[host] = now + pace * row[2]
        yield row


def fetched(urls: DataFrame, pace: float = 1.0, tasks: int | None = None, window: int = WINDOW, per: int = LANE, fetch: Callable[[str], tuple] = http.fetch) -> DataFrame:
    """(url, status, text, error): a row for each distinct URL of urls (url); nulls are left out.

    A host gets a request every pace seconds at most, over all its lanes; tasks: partitions,
    as many as shuffles have if not given. fetch gives (status, text, error) and doesn't
    raise. A lost executor's URLs are fetched again: keep the result as a table.
    """
    own = lanes(urls, per)
    tasks = tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartition(tasks, "host", "lane").select("url", "host", "of")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([x[0] for _, x in found], pa.int32()), *[pa.array([x[k] for _, x in found], pa.string()) for k in (1, 2)]], names=["url", "status", "text", "error"])

        rows = (tuple(r) for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found, size = [], 0
        for url, x in in_order(((r[0], r[0]) for r in in_turn(rows, pace)), fetch, window):
            found.append((url, x))
            size += len(x[1] or "")
            if len(found) == 100 or size > 4 << 20:
                yield out(found)
                found, size = [], 0
        if found:
            yield out(found)

    return dealt.mapInArrow(run, _FETCHED)


def absolute_of(base: str | None, link: str | None) -> str | None:
    """A link as its page means it, without its fragment; null if it is none to http(s)."""
    try:
        found = urljoin(base or "", link or "").partition("#")[0]
    except ValueError:
        return None
    return found if link and found.lower().startswith(("http://", "https://")) else None


@F.pandas_udf(StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([absolute_of(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def detail_link(html: Column, target: Column, mark: str = r"(?i)read more|release notes|full notes|details|更新|详情", reach: int = 4000) -> Column:
    """The first link of "read more" kind within reach characters after the first mention of the target; null if none."""
    quoted = F.regexp_replace(V.bare(target), r"([.+*?^$(){}|\[\]\\])", r"\\$1")
    place = F.regexp_instr(html, F.concat(F.lit(r"(?<![0-9.])"), quoted, F.lit(r"(?![0-9.])")))
    after = F.when(place > 0, F.substr(html, place, F.lit(reach)))
    anchors = F.regexp_extract_all(F.coalesce(after, F.lit("")), F.lit(r"(?is)<a\b[^>]+href=[^>]+>.*?</a>"), 0)
    kept = F.filter(anchors, lambda a: T.clean_text(a).rlike(mark))
    return F.nullif(F.regexp_extract(F.get(kept, F.lit(0)), r"""(?i)href=["']?([^"'\s>]+)""", 1), F.lit(""))


def followed(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): the page that each page's changelog is on, if it links to one.

    The link with the largest version, else the one that tells more of the target. A link
    to the page itself is none. pages: page_id, url, html, target.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce(T.largest_link(html)["href"], detail_link(html, F.col("target"))).alias("href"))
    rows = rows.where("href is not null").withColumn("link", absolute("url", "href"))
    return rows.where(F.col("link").isNotNull() & (F.col("link") != F.regexp_replace(F.coalesce("url", F.lit("")), "#.*", ""))).select("page_id", "url", "link")


def frontier(links: DataFrame, cache: DataFrame, now: Column, hours: int = 24, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(known, open) of links (link): (link, text) that a fresh cache (key, ts, body) has, and the URLs (url) to fetch.

    seen (url): what has been fetched before, without success, and isn't to be again.
    """
    once = links.select(F.col("link").alias("url")).distinct()
    hits, misses = registries.cached(once, cache, now, hours)
    newest = hits.groupBy("url").agg(F.max_by("body", "ts").alias("text"))
    open_ = misses.select("url")
    if seen is not None:
        open_ = open_.join(seen.select("url"), "url", "left_anti")
    return newest.select(F.col("url").alias("link"), "text"), open_


def with_linked(pages: DataFrame, cache: DataFrame, now: Column, hours: int = 24, seen: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(pages with link and linked, the HTML of the page that theirs links to, rows for the cache).

    pages: page_id, url, html, target, and any others. Pages without a link, or whose
    fetch failed, have linked null. how: as fetched() takes it. The second table is what was
    fetched: url, status, text, error, and key, ts and body where it can go into the cache.
    """
    links = written(followed(pages))
    known, open_ = frontier(links, cache, now, hours, seen)
    got = written(fetched(open_, **how))
    good = (F.col("status") == 200) & (F.col("text") != "")
    texts = known.unionByName(got.where(good).select(F.col("url").alias("link"), "text"))
    linked = links.join(texts, "link", "left").select("page_id", "link", F.col("text").alias("linked"))
    new = got.withColumn("key", F.when(good, F.left(F.sha1(F.col("url").cast("binary")), F.lit(24)))).withColumns({"ts": F.when(good, now), "body": F.when(good, F.col("text"))})
    return pages.drop("link", "linked").join(linked, "page_id", "left"), new
