"""The rule-based choice of a page's version: scores, overrides, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V
from ..plans.tables import joined
from .candidates import occurrences, sequences
from .mentions import mentions

#: Weights of scopes and patterns.
SCOPE_WEIGHT = {"title": 3, "structured": 3, "body": 2, "url": 2, "heading": 2, "changelog-header": 8, "changelog-url": 14}
PATTERN_WEIGHT = {"semver": 2, "minor": 1, "major": 0}


def _weight(of: str, weights: dict[str, int]):
    out = F.lit(0)
    for k, w in weights.items():
        out = F.when(F.col(of) == k, w).otherwise(out)
    return out


def scored(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(page_id, version, score, scope, pattern, in_download, in_text, ord) for each candidate version.

    An occurrence brings 2 if any link has the version and 4 if a download link has; once
    come the weights of the first scope and pattern, 3 for each structured occurrence, 2
    for each further scope, and up to 5 for the times it stands in the page.
    """
    if found is None:
        series = sequences(pages).select("page_id", F.lit(10_000_000_000).alias("ord"), F.col("latest").alias("version"), F.lit("major").alias("pattern"), F.lit("heading").alias("scope"))
        found = occurrences(pages).unionByName(series)
    html = F.coalesce(F.col("html"), F.lit(""))
    links = T.links(html)
    page = pages.select("page_id", html.alias("html"), F.array_join(links, "\n").alias("links"), F.array_join(F.filter(links, V.download_url), "\n").alias("downloads"), F.concat_ws("\n", T.title(html), T.meta_text(html), T.body_text(html)).alias("seen"))
    first = F.struct("ord")
    per = found.groupBy("page_id", "version").agg(
        F.min_by("scope", first).alias("scope"), F.min_by("pattern", first).alias("pattern"), F.min("ord").alias("ord"),
        F.count("*").alias("n"), F.count_if(F.col("scope") == "structured").alias("n_structured"), F.count_distinct("scope").alias("n_scopes"),
    )
    rows = joined(per, mentions(page, per), ["page_id", "version"])
    score = F.col("n") * (F.when(F.col("in_links"), 2).otherwise(0) + F.when(F.col("in_downloads"), 4).otherwise(0)) + _weight("scope", SCOPE_WEIGHT) + _weight("pattern", PATTERN_WEIGHT) + 3 * F.col("n_structured") + 2 * (F.col("n_scopes") - 1) + F.least("times", F.lit(5))
    return rows.select("page_id", "version", score.cast("long").alias("score"), "scope", "pattern", F.col("in_downloads").alias("in_download"), F.col("in_seen").alias("in_text"), "ord")


def picked(scores: DataFrame) -> DataFrame:
    """(page_id, version, score, scope, in_download, in_text, confidence, n_candidates): one row for each page with candidates.

    The best score wins, first come on ties, but: the greatest version of a changelog
    header, if greater; else, where scores are close as in a list of versions, the
    greatest one with a download link or 0.7 of the best score; and the greatest version
    of changelog links.
    """
    page = Window.partitionBy("page_id")
    rows = scores.withColumns({"key": V.three_key(F.col("version")), "n": F.count("*").over(page), "top": F.max("score").over(page), "nth": F.row_number().over(page.orderBy(F.desc("score"), "ord"))})
    rows = rows.withColumn("second", F.max(F.when(F.col("nth") == 2, F.col("score"))).over(page))
    me = F.struct("key", (-F.col("ord")).alias("ord"), "version", "score", "scope", "in_download", "in_text")
    fits = (F.col("n") >= 3) & (F.col("top") > 0) & (F.col("second") * 2 >= F.col("top")) & (F.col("in_download") | (F.col("score") * 10 >= F.col("top") * 7))
    one = rows.groupBy("page_id").agg(
        F.max(F.when(F.col("nth") == 1, me)).alias("best"), F.max(F.when(F.col("scope") == "changelog-header", me)).alias("header"),
        F.max(F.when(fits, me)).alias("listed"), F.max(F.when(F.col("scope") == "changelog-url", me)).alias("log"), F.max("n").alias("n_candidates"),
    )
    listed = F.when(F.col("listed.key") > F.col("best.key"), F.col("listed")).otherwise(F.col("best"))
    pick = F.when(F.col("header").isNotNull(), F.when(F.col("header.key") > F.col("best.key"), F.col("header")).otherwise(F.col("best"))).otherwise(F.coalesce("log", listed))
    out = one.select("page_id", "n_candidates", pick.alias("p")).select("page_id", "p.version", "p.score", "p.scope", "p.in_download", "p.in_text", "n_candidates")
    lonely = F.col("scope").isin("structured", "body") & ~F.col("in_download") & ~F.col("in_text")
    confidence = F.when(lonely, "low").when(F.col("in_download") & (F.col("score") >= 7) & F.col("in_text"), "high").when((F.col("scope") == "title") & (F.col("score") >= 7), "high")
    confidence = confidence.when((F.col("scope") == "structured") & (F.col("score") >= 6) & F.col("in_download"), "high").when((F.col("score") >= 5) & F.col("in_text"), "medium").otherwise("low")
    return out.withColumn("confidence", confidence)


def extracted(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, version, source, confidence, needs_ai, needs_browser, pattern.

    JSON bodies are read by their version fields; pages without candidates get a null
    version, source none and low confidence.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    json = F.when(T.is_json(html), T.json_version(html))
    best = picked(scored(pages)).select("page_id", F.col("version").alias("ruled"), F.col("scope"), F.col("confidence").alias("ruled_confidence"))
    rows = pages.select("page_id", json.alias("json"))
    rows = joined(rows, best, "page_id", "left")
    version = F.coalesce("json", "ruled")
    source = F.when(F.col("json").isNotNull(), "json").otherwise(F.coalesce("scope", F.lit("none")))
    confidence = F.when(F.col("json").isNotNull(), "high").otherwise(F.coalesce("ruled_confidence", F.lit("low")))
    rows = rows.select("page_id", version.alias("version"), source.alias("source"), confidence.alias("confidence"))
    return rows.select("*", (F.col("confidence") != "high").alias("needs_ai"), (F.col("confidence") == "low").alias("needs_browser"), F.when(F.col("version").isNotNull(), V.suggested_pattern(F.col("version"))).alias("pattern"))


def top_candidates(scores: DataFrame, k: int = 5) -> DataFrame:
    """(page_id, rank, version, score): the k best of each page."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    return scores.select("page_id", rank.alias("rank"), "version", "score").where(F.col("rank") <= k)
