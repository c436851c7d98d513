"""Jobs of several operators: candidates as training data, and what rendering adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import candidates, labels
from ..sources import files
from .tables import written


def export_candidates(pages: DataFrame, path: str) -> DataFrame:
    """Labelled candidates of pages (page_id, url, product, html, label) as JSON lines under path, and as they were read back."""
    rows = candidates.labelled(candidates.contexts(pages), pages)
    files.write_json_lines(rows, path)
    return files.json_lines(rows.sparkSession, path, "page_id long, version string, text string, label int, reason string")


def render_coverage(pages: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """(page_id, version, scopes, text, source, is_expected): candidates of pages as they are, and of those whose expected version isn't among them also as rendered.

    pages: page_id, product, html, rendered, expected; network: page_id, version, count, scope
    of what a page loads: versions of two answers or more, and those of other scopes, count too.
    """
    static = written(candidates.contexts(pages.select("page_id", "product", "html")))
    open_ = labels.uncovered(pages, static)
    shown = candidates.contexts(open_.where("rendered is not null").select("page_id", "product", F.col("rendered").alias("html")))
    found = shown.select("page_id", "version", F.lit(0).alias("ord"), "scopes", candidates.sample_text(F.col("version"), F.col("contexts")).alias("text"))
    if network is not None:
        more = network.join(open_.select("page_id"), "page_id").where("scope <> 'structured' or count >= 2")
        said = F.concat_ws(" ", F.lit("candidate:"), "version", F.lit("[SEP] context:"), F.concat(F.lit("["), "scope", F.lit("]")), F.lit("seen"), F.col("count").cast("string"), F.lit("times"))
        found = found.unionByName(more.select("page_id", V.normalized(F.col("version")).alias("version"), F.lit(1).alias("ord"), F.array("scope").alias("scopes"), said.alias("text")))
    own = static.select("page_id", "version", F.lit(0).alias("ord"), "scopes", candidates.sample_text(F.col("version"), F.col("contexts")).alias("text"))
    rows = labels.with_rendered(own, found).join(pages.select("page_id", "expected"), "page_id")
    return rows.select("page_id", "version", "scopes", "text", "source", F.coalesce(V.matches(F.col("version"), F.col("expected")), F.lit(False)).alias("is_expected"))


def coverage(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(pages, static, all, candidates): of how many pages the expected version is a candidate without and with rendering; rows as of render_coverage()."""
    per = rows.groupBy("page_id").agg(F.max(F.col("is_expected") & (F.col("source") == "static")).alias("s"), F.max("is_expected").alias("a"), F.count("*").alias("n"))
    joined = pages.select("page_id").join(per, "page_id", "left")
    return joined.agg(F.count("*").alias("pages"), F.count_if("s").alias("static"), F.count_if("a").alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
