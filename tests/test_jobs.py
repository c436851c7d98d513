"""Jobs of several operators, and models held against each other."""

from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.plans import jobs


def test_render_coverage(spark):
    html = lambda v: f"<html><head><title>Tool {v}</title></head><body><h1>Tool {v}</h1><p>Version {v} is out now.</p></body></html>"
    rows = [(1, "tool", html("1.2.0"), html("9.9.9"), "1.2.0"), (2, "tool", html("1.0.0"), html("2.0.0"), "2.0.0"), (3, "tool", None, None, "3.0.0"), (4, "tool", html("4.0.0"), None, "5.0.0"), (5, "tool", "<p>none</p>", html("5.1.0"), "7.0.0")]
    pages = spark.createDataFrame(rows, "page_id long, product string, html string, rendered string, expected string")
    network = spark.createDataFrame([(1, "1.3.0", 5, "structured"), (3, "3.0.0", 2, "structured"), (3, "3.3.0", 1, "structured"), (4, "5.0.0", 1, "download-link"), (5, "5.1.0", 4, "structured")], "page_id long, version string, count int, scope string")
    found = jobs.render_coverage(pages, network)
    assert {(r.page_id, r.version, r.source, r.is_expected) for r in found.collect() if r.version.count(".") == 2} == {
        (1, "v1.2.0", "static", True), (2, "v1.0.0", "static", False), (2, "v2.0.0", "l2-render", True), (3, "v3.0.0", "l2-render", True), (4, "v4.0.0", "static", False), (4, "v5.0.0", "l2-render", True), (5, "v5.1.0", "l2-render", False),
    }
    assert found.where("text is null or size(scopes) = 0").count() == 0
    assert tuple(jobs.coverage(found, pages).first()) == (5, 1, 4, found.count())
    plain = jobs.render_coverage(pages)
    assert tuple(jobs.coverage(plain, pages).first()) == (5, 1, 2, plain.count()) and jobs.coverage(plain.limit(0), pages).first()["candidates"] == 0


def test_export(spark, tmp_path):
    rows = [(1, "https://tool.example/changelog", "tool", "<title>Tool 1.2.0</title><p>Version 1.2.0 and library 7.7.7</p>", "1.2.0"), (2, "https://tool.example/x", "tool", "<p>Version 3.0.0</p>", "9.0.0"), (3, "https://tool.example/y", "tool", None, "1.0")]
    found = jobs.export_candidates(spark.createDataFrame(rows, "page_id long, url string, product string, html string, label string"), f"{tmp_path}/out")
    got = {(r.page_id, r.version): (r.label, r.reason) for r in found.collect()}
    assert got[1, "v1.2.0"] == (1, "matches-live-label") and got[1, "v7.7.7"][0] is None and all(p == 1 for p, _ in got)


def test_models(spark):
    """Ties, pages without candidates, and a model that has none of some pages."""
    rows = [(1, "v1.0", "a", 0.5), (1, "v2.0", "a", 0.5), (1, "v2.0", "b", 0.9), (1, "v1.0", "b", 0.1), (2, "v3.1", "a", 0.2), (2, "v4.0", "a", 0.9), (2, "v3.1", "b", 0.7), (3, "v5", "a", 1.0)]
    scored = spark.createDataFrame(rows, "page_id long, version string, model string, score double")
    pages = spark.createDataFrame([(1, "1.0"), (2, "3"), (3, "6"), (4, "1")], "page_id long, expected string")
    assert {tuple(r) for r in evaluate.holdout(scored, pages).collect()} == {("a", 4, 1, 0.25, 2, 1, 0.5), ("b", 4, 1, 0.25, 2, 1, 0.5)}
    assert {(r.page_id, r.old_version, r.new_version, r.change) for r in evaluate.changes(scored, pages, "a", "b").collect()} == {(1, "v1.0", "v2.0", "worse"), (2, "v4.0", "v3.1", "better")}
    assert evaluate.holdout(scored.where(F.lit(False)), pages).count() == 0
