"""The audit of decisions: one row for each URL, the latest wins, and its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V


def audit_id(url: Column) -> Column:
    return F.left(F.sha1(url.cast("binary")), F.lit(24))


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each URL by ts, with its id."""
    order = Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("seq"))
    return entries.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k").withColumn("id", audit_id(F.col("url")))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new in place of those of the same id."""
    return stored.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def replaced_candidates(stored: DataFrame, new: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates (extraction_id, ...) where those of the given entries give way to new ones."""
    ids = entries.select(F.col("id").alias("extraction_id")).distinct()
    return stored.join(ids, "extraction_id", "left_anti").unionByName(new)


def for_url(extractions: DataFrame, candidates: DataFrame, url: str) -> DataFrame:
    """A URL's entry with its candidates, likeliest first."""
    own = extractions.where(F.col("id") == audit_id(F.lit(url)))
    return own.join(candidates.withColumnRenamed("extraction_id", "id"), "id").orderBy(F.desc("prob"))


def listed(extractions: DataFrame, candidates: DataFrame, version: str | None = None, answer_differs: bool = False, limit: int = 50) -> DataFrame:
    """The newest entries, 1 to 200 of them: those whose version, or a candidate's, holds a text; those whose answer differs from the result."""
    rows = extractions
    if answer_differs:
        rows = rows.where("llm_triggered and llm_answer is not null and llm_answer <> final_version")
    if version:
        bare = version.lstrip("vV")
        hit = candidates.where(F.contains("version", F.lit(bare))).select(F.col("extraction_id").alias("id")).distinct()
        inside = rows.join(hit, "id", "left_semi")
        named = rows.where(F.coalesce(F.contains("final_version", F.lit(bare)), F.lit(False)))
        rows = inside.unionByName(named.join(hit, "id", "left_anti"))
    return rows.orderBy(F.desc("ts"), "id").limit(min(max(limit, 1), 200))


def trusted(extractions: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries with the check of their version against the stored one (url, stored)."""
    rows = extractions.join(stored, "url", "left")
    v = F.col("final_version")
    return rows.withColumns({"verdict": V.cross_check(v, F.col("stored")), "trust": V.trusted(v, F.col("stored"), F.col("final_confidence"))})
