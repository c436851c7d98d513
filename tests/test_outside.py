"""Calls and fetches: slow, failing and hanging ones, paces, lanes, and pages that pages link to. Servers are local."""

import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asking, changelog
from tidemark.sources import fetching


def test_window():
    """Never more calls at once than the window; the order stays, though the first is the slowest."""
    lock, now, most = threading.Lock(), [0], [0]

    def call(p):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.3 if p == 0 else 0.01)
        with lock:
            now[0] -= 1
        return p * 2

    began = time.time()
    assert list(asking.in_order(((k, k) for k in range(60)), call, 5)) == [(k, 2 * k) for k in range(60)]
    assert most[0] <= 5 and time.time() - began < 5


def test_one_call():
    def fails(p):
        raise TimeoutError("its own")

    began = time.time()
    assert asking.one_call(lambda p: time.sleep(60), "x", 0.2) == (None, "deadline")
    assert asking.one_call(fails, "x", 5) == (None, "TimeoutError: its own") and time.time() - began < 5
    assert asking.chained([fails, lambda p: "", lambda p: p + "!"], "x", 5, bool) == ("x!", "TimeoutError: its own; no answer", 2)
    assert asking.chained([lambda p: "never"], "x", 5, lambda a: a == "1") == (None, "answer not accepted", None)
    assert asking.chained([fails], None, 5, bool) == (None, "no prompt", None)


def test_asked(spark):
    """Slow, failing, hanging and useless services; each row once, each failure a row."""
    from tidemark.operators import arbitration

    def first(p):
        kind = int(p.split()[-1]) % 5
        if kind == 1:
            raise ValueError("busy")
        if kind == 2:
            time.sleep(60)
        time.sleep(0.02)
        return "no idea" if kind == 3 else f"It is v{p.split()[-1]}.2.0, I think"

    def second(p):
        return None if p.endswith("1") else "7.1"

    rows = spark.createDataFrame([(i, f"which {i}", "clash") for i in range(40)] + [(40, None, None)], "page_id long, prompt string, answer string")
    began = time.time()
    found = {r.page_id: r for r in arbitration.answered(rows, [first, second], window=4, seconds=1.0, tasks=2).collect()}
    assert len(found) == 41 and time.time() - began < 30
    for i in range(40):
        kind = i % 5
        want = f"v{i}.2.0" if kind in (0, 4) else None if kind == 1 and i % 10 == 1 else "v7.1"
        assert found[i].answer == want and (found[i].error or "").split(";")[0] == {1: "ValueError: busy", 2: "deadline", 3: "answer not accepted"}.get(kind, "")
    assert found[40].answer is None and found[40].error == "no prompt"
    none = arbitration.answered(rows, None)
    assert none.columns == ["page_id", "answer", "error"] and none.where("answer is not null").count() == 0
    settled = arbitration.settled(spark.createDataFrame([(0, "v9", 0.01), (1, "v8", 0.01)], "page_id long, version string, margin double"), arbitration.answered(rows.limit(2), second))
    assert {(r.page_id, r.version, r.confidence) for r in settled.collect()} == {(0, "v7.1", "high"), (1, "v8", "low")}


def test_in_turn():
    """With a clock of its own: paces hold for each host, lanes slow down, and a waiting host lets others go first."""
    now = [0.0]
    rows = [(f"a{k}", "a", 1) for k in range(4)] + [(f"b{k}", "b", 3) for k in range(2)] + [("c0", "c", 1)]
    said = []
    for r in fetching.in_turn(iter(rows), 2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)):
        said.append((r[0], now[0]))
        now[0] += 0.1
    times = dict(said)
    assert sorted(times) == sorted(r[0] for r in rows) and said[:3] == [("a0", 0.0), ("b0", 0.1), ("c0", 0.2)]
    assert all(times[f"a{k + 1}"] - times[f"a{k}"] >= 2 for k in range(3)) and times["b1"] - times["b0"] >= 6
    few = [r[0] for r in fetching.in_turn(iter(rows), 2.0, look=2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))]
    assert sorted(few) == sorted(times)


def test_lanes(spark):
    rows = [(f"https://Hot.example/{k}",) for k in range(95)] + [(f"https://cold{k}.example/x",) for k in range(5)] + [(None,), ("odd",), ("https://hot.example/0",), ("https://Hot.example/1",)]
    found = fetching.lanes(spark.createDataFrame(rows, "url string"), 10).collect()
    assert len(found) == 102 and {r.of for r in found if r.host == "hot.example"} == {10} and len({r.lane for r in found if r.host == "hot.example"}) == 10
    assert all((r.of, r.lane) == (1, 0) for r in found if r.host != "hot.example") and {r.host for r in found if r.url == "odd"} == {""}


@pytest.fixture
def site():
    asked: list[tuple[str, float]] = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, time.time()))
            if self.path.startswith("/gone"):
                self.send_error(404)
                return
            notes = "<article><h2>Tool 3.2.0</h2><p>" + "This release fixes several bugs and improves the speed of searches for all of our users. " * 3 + "</p></article>"
            body = (f"<html><body>{notes} at {self.path}</body></html>").encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args): ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def _local(url):
    """Any host, as the server is a local one."""
    from tidemark.sources import http

    return http.fetch(url, attempts=1, opener=urllib.request.urlopen, check=lambda u: True)


def test_fetched(spark, site):
    base, asked = site
    urls = [f"{base}/p{k}" for k in range(12)] + [f"{base}/gone", f"{base}/p1", None, "http://127.0.0.1:1/shut"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r.url: r for r in fetching.fetched(df, pace=0.05, tasks=3, per=5, fetch=_local).collect()}
    assert len(found) == 14 and all(found[u].status == 200 and u.rsplit("/", 1)[1] in found[u].text for u in urls[:12])
    assert found[f"{base}/gone"].status == 404 and found["http://127.0.0.1:1/shut"].status == 0 and found["http://127.0.0.1:1/shut"].error
    times = sorted(t for _, t in asked)
    # three lanes of one host: at most three requests in any 3 * 0.05 seconds, give or take
    assert len(times) == 13 and times[-1] - times[0] >= 0.05 * 3 * 3
    # the usual fetch refuses private hosts
    assert {r.error for r in fetching.fetched(df, tasks=1, pace=0).collect()} == {"url not allowed"}


def test_linked(spark, site):
    """From a page to the page it links to, to its changelog; cached pages and failed ones aren't fetched again."""
    base, asked = site
    more = "<p>Version 3.2.0 is out.</p><a href='/news/tool'>Read more</a>"
    rows = [
        (1, f"{base}/changelog", "<a href='/notes/3.1.0'>3.1.0</a><a href='/notes/3.2.0'>3.2.0</a>", "3.2.0"), (2, f"{base}/news", more, "3.2.0"), (3, f"{base}/none", "<p>nothing here</p>", "3.2.0"),
        (4, f"{base}/notes/3.2.0", "<a href='#3.2.0'>3.2.0</a>", "3.2.0"), (5, f"{base}/x", "<a href='/gone/3.2.0'>3.2.0</a>", "3.2.0"), (6, None, None, None), (7, f"{base}/y", "<a href='mailto:a@3.2.0'>3.2.0</a>", None),
        (8, f"{base}/old", "<a href='/kept/3.2.0'>3.2.0</a>", None), (9, f"{base}/twice", "<a href='/notes/3.2.0#top'>3.2.0</a>", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, target string")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    cache = spark.createDataFrame([(f"{base}/kept/3.2.0", "kept", 1_699_999_000), (f"{base}/notes/3.2.0", "stale", 1_600_000_000)], "url string, body string, at long")
    cache = cache.select(F.left(F.sha1(F.col("url").cast("binary")), F.lit(24)).alias("key"), F.timestamp_seconds("at").alias("ts"), "body")
    found, new = fetching.with_linked(pages, cache, now, pace=0, tasks=2, fetch=_local)
    found, new = {r.page_id: r for r in found.collect()}, {r.url: r for r in new.collect()}
    assert {i: r.link and r.link.removeprefix(base) for i, r in found.items()} == {1: "/notes/3.2.0", 2: "/news/tool", 3: None, 4: None, 5: "/gone/3.2.0", 6: None, 7: None, 8: "/kept/3.2.0", 9: "/notes/3.2.0"}
    assert {i for i, r in found.items() if r.linked} == {1, 2, 8, 9} and found[8].linked == "kept" and "at /notes/3.2.0" in found[1].linked
    assert sorted(x for x, _ in asked) == ["/gone/3.2.0", "/news/tool", "/notes/3.2.0"]
    assert new[f"{base}/gone/3.2.0"].status == 404 and new[f"{base}/gone/3.2.0"].key is None and len(new[f"{base}/news/tool"].key) == 24
    # what was fetched is in the cache then; what failed is seen
    later = cache.unionByName(spark.createDataFrame([(r.key, r.ts, r.body) for r in new.values() if r.key], cache.schema))
    again, none = fetching.with_linked(pages, later, now, seen=spark.createDataFrame([(f"{base}/gone/3.2.0",)], "url string"), fetch=_local)
    assert none.count() == 0 and again.where("linked is not null").count() == 4 and len(asked) == 3
    # and the linked page's changelog is what by_source finds, where the page itself has none
    typed = again.select("page_id", F.lit("changelog-page").alias("type"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("feed"), "target", "html", "linked", F.lit(None).cast("string").alias("rendered"))
    empty = spark.createDataFrame([], "repo string, draft boolean, prerelease boolean, tag_name string, body string, published_at string, name string"), spark.createDataFrame([], "feed string, ord int, target string, title string, content string")
    logs = {r.page_id: r for r in changelog.by_source(typed, *empty).collect()}
    assert {i for i, r in logs.items() if r.attempt == 6} >= {1, 9} and "fixes several bugs" in logs[1].content and logs[1].version == "v3.2.0"
