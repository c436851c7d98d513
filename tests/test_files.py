"""Files and models out and in again."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.sources import files, http


def test_json_and_html(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "n": 1},\n {"name": null, "n": 2}]')
    assert [(r["name"], r.n) for r in files.json_rows(spark, str(tmp_path / "a.json"), "name string, n int").orderBy("n").collect()] == [("x", 1), (None, 2)]
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "b.jsonl"), "n int").count() == 2
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "abc.html").write_text("<p>\n1</p>")
    assert [tuple(r) for r in files.html_files(spark, str(tmp_path / "pages")).collect()] == [("abc", "<p>\n1</p>")]


def test_audit_tables(spark, tmp_path):
    files.create_audit(spark, str(tmp_path / "audit"))
    files.create_audit(spark, str(tmp_path / "audit"))
    assert [x.count() for x in files.audit(spark, str(tmp_path / "audit"))] == [0, 0]


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k % 2), k / 100, 1.0], k % 2) for k in range(60)], "id int, embedding array<float>, label int")
    model, f1 = models.embedding_model(rows.where("id < 40"), rows.where("id >= 40"))
    assert f1 == 1.0
    files.save_model(model, str(tmp_path / "m"), "filter", ["embedding"], "manifest")
    loaded, names = files.load_model(str(tmp_path / "m"), "filter")
    assert names == ["embedding"] and len(loaded.stages) == len(model.stages)
    with pytest.raises(ValueError):
        files.load_model(str(tmp_path / "m"), "rank")
    pages = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "page_id int, query array<float>")
    vectors = spark.createDataFrame([(1, 10, [2.0, 0.1]), (1, 11, [0.0, 1.0]), (2, 12, [0.0, 0.0]), (1, 9, None)], "page_id int, id int, embedding array<float>")
    assert {(r.page_id, r.id, None if r.cosine is None else round(r.cosine, 3)) for r in models.cosine_choice(pages, vectors).collect()} == {(1, 10, 0.999), (2, 12, None)}


def test_jdbc(spark, tmp_path):
    """A table of a database, whole, in parts and by a query, with the filter in the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, f"name {k}", None if k % 3 else k / 4) for k in range(50)], "id long, name string, score double")
    rows.write.jdbc(url, "app_rows", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": "name VARCHAR(40)"})
    url, how = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    whole, parts = files.jdbc(spark, url, "app_rows", **how), files.jdbc(spark, url, "app_rows", "id", (0, 50), 4, **how)
    plain = lambda df: sorted(tuple(r) for r in df.select("id", "name", "score").collect())
    assert plain(whole) == plain(parts) == plain(rows) and parts.rdd.getNumPartitions() == 4
    some = parts.where("id >= 40")
    assert some.count() == 10 and "id" in some._jdf.queryExecution().executedPlan().toString().lower().split("pushedfilters")[1]
    assert files.jdbc(spark, url, "(SELECT MAX(\"id\") AS most FROM app_rows) t", **how).first()[0] == 49


def test_feed_markdown(spark):
    from tidemark.operators.changelog import feed_items

    rows = [(1, 0, "3.2.0", "Tool 3.2.0", "<h2>New</h2><ul><li>one &amp; <b>two</b></li></ul>"), (2, 0, None, "Tool 1.5", "plain & simple, 1 < 2"), (3, 0, "9.9", "Tool 1.0", "first"), (3, 1, "9.9", "Tool 9.9", "<p>second</p>"), (4, 0, None, "empty", "")]
    found = {r.feed: (r.version, r.content) for r in feed_items(spark.createDataFrame(rows, "feed long, ord int, target string, title string, content string")).collect()}
    assert found == {1: ("v3.2.0", "## New\n\n- one & **two**"), 2: ("v1.5", "plain & simple, 1 < 2"), 3: ("v9.9", "second")}


def test_addresses():
    assert not http.allowed("https://inner.example/", lambda host: ["10.0.0.7"]) and http.allowed("https://outer.example/", lambda host: ["93.184.216.34"])
