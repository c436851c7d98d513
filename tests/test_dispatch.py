"""The main query's changelogs by the kind of their source."""

from tidemark.plans import extract


def test_dispatch(spark):
    note = "This release fixes several bugs and improves the speed of searches for all of our users. " * 3
    page = f"<html><body><article><h2>Tool 3.2.0</h2><p>{note}</p><h2>Tool 3.1.0</h2><p>older {note}</p></article></body></html>"
    rows = [
        (1, "https://github.com/tool/app/releases", page, "3.2.0", None, None), (2, "https://github.com/other/app", page, "3.2.0", None, None), (3, "https://tool.example/feed/", "", "3.2.0", None, None),
        (4, "https://bare.example/feed/", page, "3.2.0", None, None), (5, "https://tool.example/changelog", page, "3.1.0", None, None), (6, None, None, None, None, None), (7, "https://github.com/tool/app/tags", page, None, None, None),
        (8, "https://tool.example/list", "<html><body><a href='/n'>x</a></body></html>", "3.2.0", page, None), (9, "https://tool.example/js", "<html><body><div id='root'></div></body></html>", "3.2.0", None, page),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, target string, linked string, rendered string")
    published = spark.createDataFrame([("tool/app", False, False, "v3.2.0", "2026-01-02", "Three", "- a fix of the release"), ("tool/app", False, True, "v4.0.0", "2026-02-02", "Four", "- not yet")], extract.PUBLISHED)
    items = spark.createDataFrame([("https://tool.example/feed/", 0, "Tool 3.1.0", "old"), ("https://tool.example/feed/", 1, "Tool 3.2.0", "what is new in the feed")], extract.ITEMS)
    found = {r.page_id: r for r in extract.changelogs_of(pages, published, items).collect()}
    assert {i: r.attempt for i, r in found.items()}.keys() == {1, 2, 3, 4, 5, 7, 8, 9}
    assert (found[1].attempt, found[1].content) == (1, "- a fix of the release") and (found[3].attempt, found[3].content) == (2, "what is new in the feed")
    assert all(found[i].attempt == 3 and found[i].content.startswith("This release") for i in (2, 4)) and found[5].attempt == 3 and found[5].content.startswith("older")
    assert found[7].attempt in (3, 4) and found[8].attempt == 6 and found[9].attempt == 8
    # without anything published all are read as pages
    plain = {r.page_id: r.attempt for r in extract.changelogs_of(pages.select("page_id", "url", "html", "target")).collect()}
    assert plain[1] == 3 and 3 not in plain and not {8, 9} & set(plain)
