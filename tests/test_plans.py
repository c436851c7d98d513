"""Plans of operators on pages: what grows with the pages is never broadcast, whatever Spark guesses of its size."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates, changelog, families, features, heuristics
from tidemark.plans import fixture


def _broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def notes(spark, tmp_path):
    """A small file, which Spark would broadcast if it stood in a join."""
    text = "# All\n## 2.0 (2026-07-01)\n- new\n```\n## 1.9\n```\n### More\nlast\n## 1.0\n- old\n## 0.9\n- first"
    spark.createDataFrame([(1, None, text), (2, "v1.0", text), (3, "7.7", text), (4, None, None), (5, "0.9", text)], "page_id long, target string, text string").write.parquet(f"{tmp_path}/notes")
    return spark.read.parquet(f"{tmp_path}/notes")


def test_markdown_sections(notes):
    found = changelog.markdown_sections(notes)
    assert not _broadcasts(found)
    got = {r.page_id: (r.version, r.date, r.content) for r in found.collect()}
    assert got == {1: ("v2.0", "2026-07-01", "- new\n```\n## 1.9\n```\n### More\nlast"), 2: ("v1.0", None, "- old"), 5: ("v0.9", None, "- first")}


@pytest.fixture
def pages(spark):
    return fixture.pages(spark, "/root/testdata/sf0.001")


def test_rank_features(pages):
    found = candidates.contexts(pages)
    assert not _broadcasts(features.rank_features(found.select("page_id", "version", F.lit(0.5).alias("prob")), found, pages))


def test_families(spark, tmp_path):
    """One shuffle of a page's rows, no join."""
    spark.createDataFrame([(1, "v1.0", 0.9), (1, "v1.1", 0.8), (1, "v7.0", 0.5)], "page_id long, version string, prob double").write.parquet(f"{tmp_path}/scored")
    rows = spark.read.parquet(f"{tmp_path}/scored").select("*", F.array(F.lit("title")).alias("scopes"), F.lit(None).cast("string").alias("path"))
    found = families.families(rows)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.version: r.family for r in found.collect()} == {"v1.0": 1, "v1.1": 1, "v7.0": 3}


def test_rules(pages):
    assert not _broadcasts(heuristics.extracted(pages))
