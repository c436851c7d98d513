"""Operators on small inputs made by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as T
from tidemark.functions import versions as V
from tidemark.operators import candidates, changelog, families, heuristics
from tidemark.sources import registries


def _one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (V.three_key, "v1.2.3.4", [1, 2, 3]), (V.three_key, "1.27-rc.2", [1, 27, 0]), (V.four_key, "1.2.3.4", [1, 2, 3, 4]), (V.four_key, "v10+5", [10, 0, 0, 0]),
        (V.evolution_key, "1.27-rc.2", [1, 27, 2, 0, 5, 0]), (V.evolution_key, "1.27rc2", [1, 27, 2, 0, 6, 0]), (V.evolution_key, "2.0-beta3", [2, 0, 0, 0, 4, 3]),
        (V.purified, "8.5.9-src.zip", "8.5.9"), (V.purified, "1.27rc2", "1.27rc2"), (V.suspicious, "3.1884.9", True), (V.suspicious, "0.0.0", True), (V.suspicious, "1.2.3", False),
        (V.yearish, "2026.3", True), (V.date_like, "v2026.3.1", True), (V.normalized, " 1.2 ", "v1.2"), (V.canonical, "vV1.2", "v1.2"),
        (T.domain, "https://www.Example.com:8080/x", "example.com"), (T.blocked_host, "http://192.168.1.1/x", True), (T.blocked_host, "https://example.com/", False), (T.blocked_host, "ftp://example.com/", True),
        (T.without_licences, "GPL 3.0 License 2.4.1", "  2.4.1"), (T.json_version, '{"version": "1.4.2", "minimumOsVersion": "15"}', "v1.4.2"), (T.json_version, '{"minimumOsVersion": "15"}', None),
        (T.filename_versions, "Notion-7.29.0.msix", ["7.29.0"]), (T.language, "更新日志第一版", "zh"), (T.not_a_changelog, "short", True), (T.header_version, "Fixed in 8.21.0 - June", "8.21.0"),
        (T.drawings_to_text, '<p>a</p><svg d="1.2"><text>3.4.5</text></svg>b', "<p>a</p> 3.4.5 b"), (T.product_name, "Download Zephyr 3", "zephyr"), (T.answer_version, "It is 4.5.", "v4.5"),
    ],
)
def test_functions(spark, f, value, want):
    assert _one(spark, f, value) == want


def test_matches(spark):
    assert _one(spark, V.matches, "v1.2", "1.2.3") and not _one(spark, V.matches, "1.2", "1.20")
    assert _one(spark, V.cross_check, "v2.0", "1.9") == "update" and _one(spark, V.cross_check, "1.2.3.4", "1.2.3.9") == "equal"


def _pages(spark, *html):
    return spark.createDataFrame([(i, h, "tool", "https://tool.example/changelog") for i, h in enumerate(html)], "page_id long, html string, product string, url string")


def test_extraction(spark):
    pages = _pages(
        spark, "<title>tool 4.2.1</title><p>Version 4.2.1</p><a href='/download/tool-4.2.1.zip'>get</a>", "Changes with tool 1.31.3 \nfix\nChanges with tool 1.31.2 \n", None, "",
        '{"version": "8.1.0"}', "<p>Apache 2.0 License, py-2.5</p>",
    )
    found = {r.page_id: (r.version, r.source, r.confidence) for r in heuristics.extracted(pages).collect()}
    assert found[0] == ("v4.2.1", "title", "high") and found[1][:2] == ("v1.31.3", "changelog-header") and found[4] == ("v8.1.0", "json", "high")
    assert all(found[k] == (None, "none", "low") for k in (2, 3)) and len(found) == 6


def test_contexts(spark):
    pages = _pages(spark, "<h1>tool 3.2.1</h1><p>needs WCAG 2.0 and macOS 15.1, tool for Mac 10.1.0, Chrome 151, 89.3k stars</p><script>var buildNumber='7.7.7'</script>")
    found = {r.version: r.scopes for r in candidates.contexts(pages).collect()}
    assert "v2.0" not in found and "v15.1" not in found and {"v3.2.1", "v10.1.0", "v151"} <= set(found) and found["v7.7.7"] == ["noise"]


def test_sequences(spark):
    pages = _pages(spark, "<nav>tool 8.1 tool 8.2 tool 8.3</nav>", "<h2>tool 1.1</h2><h2>tool 9</h2><h2>tool 50.2.2</h2>")
    assert [(r.page_id, r.latest) for r in candidates.sequences(pages).collect()] == [(0, "v8.3")]


def test_families(spark):
    rows = [(0, v, 0.9, ["visible"], p, 1.0) for v, p in [("v1.1.0", "h2"), ("v1.2.0", "h2"), ("v2.0.0", "h2"), ("v3.0.0", "li"), ("v3.1.0", "li"), ("v2026.3", None)]]
    df = spark.createDataFrame(rows, "page_id int, version string, prob double, scopes array<string>, path string, score double")
    found = {r.version: r.family for r in families.families(df).collect()}
    assert found["v1.1.0"] == found["v1.2.0"] == found["v2.0.0"] != found["v3.0.0"] == found["v3.1.0"] != found["v2026.3"]
    assert families.selected(df).first()["version"] == "v2.0.0"
    assert families.selected(df, df.where("version = 'v3.0.0'").select("page_id", "version")).first()["version"] == "v3.1.0"


def test_changelogs(spark):
    text = "Intro\n```\n# 9.9.9 no heading\n```\n## 2026-07-24 (3.5.4)\n- one\n### more\n- two\n## 3.5.3\n- old"
    df = spark.createDataFrame([(0, None, text), (1, "v3.5.3", text), (2, "9.9.9", text), (3, None, None)], "page_id int, target string, text string")
    found = {r.page_id: (r.version, r.date, r.content) for r in changelog.markdown_sections(df).collect()}
    assert found == {0: ("v3.5.4", "2026-07-24", "- one\n### more\n- two"), 1: ("v3.5.3", None, "- old")}
    page = "<div id='v2.1'>" + "<p>Fixed a crash when opening very large files on slow disks.</p>" + "</div><div id='v2.0'><p>older text of the release before</p></div>"
    df = spark.createDataFrame([(0, "2.1", page)], "page_id int, target string, html string")
    assert changelog.changelogs(df).first()["content"] == "Fixed a crash when opening very large files on slow disks."


def test_registries(spark):
    requests = spark.createDataFrame([(1, "Tool Box", "https://docs.toolbox.example/x")], "request_id int, product string, url string")
    entries = spark.createDataFrame([("toolbox", "https://toolbox.example", "2.0"), ("toolbox@beta", "https://toolbox.example", "3.0"), ("toolbox", "https://other.example", "9.0")], "token string, homepage string, version string")
    found = {(r.token, r.version, r.prerelease) for r in registries.matched_entries(requests, entries).collect()}
    assert found == {("toolbox", "v2.0", False), ("toolbox@beta", "v3.0", True)}
    assert _one(spark, registries.official, "https://registry.npmjs.org/x", '{"dist-tags": {"latest": "5.1.0"}}')["version"] == "v5.1.0"
    assert _one(spark, registries.official, "https://www.postgresql.org/", '[{"major": "17", "current": false}, {"major": "18", "current": true}]')["version"] == "v18"


def test_html():
    assert H.paths_of("<body><ul><li>v1.2.3<li>2.0.1</ul><h2><b>3.1</b></h2>") == {("v1.2.3", "li"), ("v2.0.1", "li"), ("v3.1", "h2>b")}
    assert H.markdown_of("<h1>A</h1><p>b <a href='/x'>c</a><ul><li>d<li>e</ul>") == "# A\n\nb [c](/x)\n\n- d\n- e"
    assert H.markdown_of(None) == "" and "Home" not in H.main_text_of("<p><a href='/'>Home</a> <a href='/a'>About</a></p><p>A real sentence of some words.</p>")


def test_stream(spark, tmp_path):
    from tidemark.streaming.audit import audit_table, keep_audit, page_stream

    rows = [(1, "u", "<title>tool 1.0.0</title>", "2026-01-01 00:00:00"), (2, "u", "<title>tool 2.0.0</title>", "2026-01-02 00:00:00"), (3, "w", None, "2026-01-01 00:00:00")]
    spark.createDataFrame(rows, "page_id long, url string, html string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = keep_audit(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "audit"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r.url, r.version) for r in audit_table(spark, str(tmp_path / "audit")).collect()} == {("u", "v2.0.0"), ("w", None)}
