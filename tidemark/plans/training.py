"""Training the ranker behind the main query, from pages whose version is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, datasets, features, ranker
from .extract import scored_by_rules
from .tables import joined, written


def ranking_rows(pages: DataFrame, wanted: Column, score=scored_by_rules) -> DataFrame:
    """A table of page_id, version, label (2 for the wanted version, 1 for one it begins, 0), fold and rank features.

    pages: page_id, url, product, html, and what wanted is made of. Pages none of whose
    candidates is the wanted version teach nothing and are left out; folds are by page.
    """
    found = written(candidates.contexts(pages))
    rows = features.rank_features(score(found), found, pages)
    rows = joined(rows, pages.select("page_id", wanted.alias("_wanted")), "page_id")
    label = F.coalesce(datasets.graded(F.col("version"), F.col("_wanted"), F.lit(False)), F.lit(0))
    return written(datasets.split(datasets.with_target(rows.withColumn("label", label).drop("_wanted")), "page_id"))


def trained_ranker(pages: DataFrame, wanted: Column, **how) -> ranker.Ranker:
    """A ranker of the candidates of such pages; how as ranker.trained() takes it."""
    return ranker.trained(ranking_rows(pages, wanted), features.RANK_COLUMNS, **how)


def scoring(model: ranker.Ranker):
    """The function of rank features that extract() takes as rank."""
    return lambda rows: ranker.ranked(model, rows)
