"""The main query: from pages to versions and changelogs, the model path with the rules to fall back on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V
from ..operators import arbitration, candidates, changelog, families, features, heuristics
from ..sources import registries
from .tables import joined, written


def scored_by_rules(found: DataFrame) -> DataFrame:
    """Candidates with a probability from their scopes and shape, where no model is at hand."""
    weight = sum((F.array_contains("scopes", s).cast("double") * w for s, w in {"structured": 0.25, "download-link": 0.25, "title": 0.2, "heading": 0.15, "meta": 0.1, "visible": 0.1}.items()), F.lit(0.1))
    return found.withColumn("prob", F.least(F.lit(0.99), weight + F.when(V.clean(F.col("version")), 0.1).otherwise(0.0) - F.when(V.yearish(F.col("version")), 0.1).otherwise(0.0)))


PUBLISHED = "repo string, draft boolean, prerelease boolean, tag_name string, published_at string, name string, body string"
ITEMS = "feed string, ord int, title string, content string"


def changelogs_of(pages: DataFrame, published: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(page_id, attempt, content): each page's changelog by the kind of its source.

    pages: page_id, url, html, target and, if known, linked and rendered. A page whose
    repository or feed has nothing published is read as a page. What by_source() finds
    nothing for has attempt 10, the best section of its markup, of any length.
    """
    spark = pages.sparkSession
    published = published if published is not None else spark.createDataFrame([], PUBLISHED)
    items = items if items is not None else spark.createDataFrame([], ITEMS)
    items = items if "target" in items.columns else items.withColumn("target", F.lit(None).cast("string"))
    kind = registries.classified(F.col("url"))
    more = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("linked", "rendered")]
    rows = pages.select("page_id", "html", "target", *more, kind["type"].alias("type"), F.concat_ws("/", kind["owner"], kind["repo"]).alias("repo"), F.col("url").alias("feed"))
    for name, key, known in (("github-releases", "repo", published), ("rss", "feed", items)):
        has = known.select(F.col(key), F.lit(True).alias("has")).distinct()
        rows = rows.join(has, key, "left").withColumn("type", F.when((F.col("type") == name) & F.col("has").isNull(), "changelog-page").otherwise(F.col("type"))).drop("has")
    rows = written(rows.withColumn("type", F.when(F.col("type").isin("github-tags", "none"), "changelog-page").otherwise(F.col("type"))))
    found = written(changelog.by_source(rows, published, items).select("page_id", "attempt", "content"))
    rest = changelog.changelogs(joined(rows, found.select("page_id"), "page_id", "left_anti").select("page_id", "html", "target"))
    return found.unionByName(rest.select("page_id", F.lit(10).alias("attempt"), "content"))


def extract(pages: DataFrame, score=scored_by_rules, rank=None, ask=None, registry: DataFrame | None = None, published: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, version, source, confidence, changelog, source_type.

    pages: page_id, url, product, html and, if known, linked and rendered. score: candidates
    to prob; rank: rank features to score; ask: prompt to answer; registry: page_id, version
    known from a registry; published: releases of repositories; items: those of feeds. In
    order: registry, JSON bodies, seed or family, rules. Every page gives a row. Parts of the
    plan are written as tables, so that each is planned, and computed, once.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    found = written(candidates.contexts(pages))
    scored = score(found).withColumn("path", F.lit(None).cast("string"))
    hits = candidates.product_hits(pages)
    if rank is None:
        chosen = families.selected(scored, hits).select("page_id", F.col("version").alias("chosen"), F.when(F.col("prob") >= 0.7, "high").when(F.col("prob") >= 0.3, "medium").otherwise("low").alias("how"))
    else:
        ranked = written(joined(scored, rank(features.rank_features(scored, found, pages)).select("page_id", "version", "score"), ["page_id", "version"]))
        seeds = written(families.selected_by_seed(ranked))
        answers = arbitration.answered(arbitration.prompts(seeds, found, pages), ask)
        chosen = arbitration.settled(seeds, answers).select("page_id", F.col("version").alias("chosen"), F.col("confidence").alias("how"))
    rules = heuristics.extracted(pages).select("page_id", F.col("version").alias("ruled"), F.col("source").alias("rule_source"), F.col("confidence").alias("rule_confidence"))
    chosen, rules = written(chosen), written(rules)
    rows = pages.select("page_id", "url", F.when(T.is_json(html), T.json_version(html)).alias("json"))
    rows = joined(joined(rows, chosen, "page_id", "left"), rules, "page_id", "left")
    rows = joined(rows, registry.select("page_id", F.col("version").alias("known")), "page_id", "left") if registry is not None else rows.withColumn("known", F.lit(None).cast("string"))
    version = F.coalesce("known", "json", "chosen", "ruled")
    source = F.when(F.col("known").isNotNull(), "registry").when(F.col("json").isNotNull(), "json").when(F.col("chosen").isNotNull(), "model").otherwise(F.col("rule_source"))
    confidence = F.when(F.coalesce("known", "json").isNotNull(), "high").when(F.col("chosen").isNotNull(), F.col("how")).otherwise(F.col("rule_confidence"))
    rows = rows.select("page_id", version.alias("version"), source.alias("source"), confidence.alias("confidence"), registries.classified(F.col("url"))["type"].alias("source_type"))
    rows = written(rows)
    own = pages.select("page_id", "url", "html", *[c for c in ("linked", "rendered") if c in pages.columns])
    logs = changelogs_of(joined(own, rows.select("page_id", F.col("version").alias("target")), "page_id"), published, items)
    return joined(rows, logs.select("page_id", F.col("content").alias("changelog")), "page_id", "left")
