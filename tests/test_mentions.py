"""Mentions of candidates against a search of each by its own pattern."""

import random
import re

from tidemark.operators.mentions import apart, found_in, mentions


def _tag(html, bare):
    at = html.find(bare)
    m = re.search(r"<(/?[a-z0-9]+)\b[^>]*>[^<]*$", html[max(0, at - 80) : at], re.I) if at >= 0 else None
    return m[1].lower() if m else None


def _plain(html, links, downloads, seen, version):
    bare = re.sub("^[vV]", "", version)
    return {
        "version": version, "times": html.count(bare), "bounded": len(re.findall(rf"(?i)(?<![0-9.]){re.escape(bare)}(?![0-9.])", html)), "first": html.lower().find(bare.lower()), "tag": _tag(html, bare),
        "in_links": bare in links, "in_downloads": bare in downloads, "in_seen": bare in seen,
    }


def _page(rng):
    bits = ["1", "2", "10", ".", ".", "1.2", "1.2.3", "v1.2", " ", "<p>", "</p>", '<a href="/x-1.2">', "<LI>", "<br>", "rc1", "RC1", "2.0-rc1", "text ", "é", "İ", "<", ">", "x" * 70]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))


VERSIONS = ["v1.2", "1.2.3", "v1", "2", "v1.2.3.1", "2.0-rc1", "v2.0-RC1", "1.1", "v10.1", "11", "v1.21"]


def test_found():
    rng = random.Random(6)
    for _ in range(800):
        texts = [_page(rng) for _ in range(4)]
        own = rng.sample(VERSIONS, rng.randint(0, 6))
        got = found_in(*texts, [(v, re.sub("^[vV]", "", v)) for v in own])
        assert got == [_plain(*texts, v) for v in own]


def test_apart():
    assert apart([0, 1, 2, 3, 4], 2) == 3 and apart([], 3) == 0 and apart([5], 9) == 1


def test_mentions(spark):
    """As tables: nulls, repeated candidates, pages without candidates and candidates without a page."""
    rng = random.Random(7)
    pages = [(i, _page(rng), "a 1.2\nb", None, "clash") for i in range(30)] + [(30, None, None, None, "")]
    cands = [(i, v) for i in range(31) for v in rng.sample(VERSIONS, 4) if i % 7] + [(2, "v1.2"), (2, "v1.2"), (3, None), (99, "v1.2")]
    found = mentions(spark.createDataFrame(pages, "page_id long, html string, links string, seen string, times string"), spark.createDataFrame(cands, "page_id long, version string"))
    want = {(i, v): _plain(pages[i][1] or "", pages[i][2] or "", "", "", v) for i, v in cands if v and i < 31}
    got = {(r.page_id, r.version): {k: r[k] for k in ("version", "times", "bounded", "first", "tag", "in_links", "in_downloads", "in_seen")} for r in found.collect()}
    assert got == want and found.count() == len(want)


def test_plan(spark):
    """Candidates meet pages once: no html beside them."""
    pages = spark.createDataFrame([(1, "1.2")], "page_id long, html string")
    found = mentions(pages, spark.createDataFrame([(1, "v1.2"), (1, "v1.3")], "page_id long, version string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") <= 1 and [r.times for r in found.orderBy("version").collect()] == [1, 0]
