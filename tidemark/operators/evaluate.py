"""Measures of extraction and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V


def benchmark(rows: DataFrame) -> DataFrame:
    """One row of counts and shares for (actual, expected, has_changelog, wants_changelog)."""
    ok = F.coalesce(V.matches_prefix(F.col("actual"), F.col("expected")), F.lit(False))
    n = F.count("*")
    return rows.agg(n.alias("n"), F.count_if(ok).alias("passed"), F.count_if(F.col("wants_changelog")).alias("n_changelog"), F.count_if(F.col("wants_changelog") & F.col("has_changelog")).alias("passed_changelog"), F.round(F.count_if(ok) / n, 6).alias("share"))


def strict_and_honest(rows: DataFrame) -> DataFrame:
    """Shares of (actual, expected) that match, and that match or are newer."""
    strict = F.coalesce(V.matches_prefix(F.col("actual"), F.col("expected")), F.lit(False))
    honest = strict | F.coalesce(V.three_key(F.col("actual")) > V.three_key(F.col("expected")), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(strict).alias("strict"), F.count_if(honest & F.col("actual").isNotNull()).alias("honest"))


def crosstab(rows: DataFrame) -> DataFrame:
    """Counts of (a_ok, b_ok)."""
    return rows.groupBy("a_ok", "b_ok").agg(F.count("*").alias("n"))


def classification(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion counts of (label, predicted)."""
    tp, fp, fn, tn = (F.count_if((F.col("label") == a) & (F.col("predicted") == b)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), safe(tp + tn, F.count("*")).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ranking(rows: DataFrame) -> DataFrame:
    """Top-one hits and mean reciprocal rank over pages of (page_id, version, score, label)."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "version")
    ranked = rows.withColumn("k", F.row_number().over(order))
    per = ranked.groupBy("page_id").agg(F.min(F.when(F.col("label") == 1, F.col("k"))).alias("first"))
    return per.agg(F.count("*").alias("pages"), F.count_if(F.col("first") == 1).alias("hits"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def fused(rows: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(page_id, version, fused): prob and score brought to 0..1 within the page, mixed alpha to 1 - alpha; 0.5 where all are equal."""
    page = Window.partitionBy("page_id")

    def unit(c: str):
        lo, hi = F.min(c).over(page), F.max(c).over(page)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    return rows.select("page_id", "version", (alpha * unit("prob") + (1 - alpha) * unit("score")).alias("fused"))


def chosen_within_major(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, version): the greatest of those over a threshold in the wanted major number; the likeliest if there is none. rows: page_id, version, prob, wanted."""
    key = V.four_key(F.col("version"))
    fit = (F.col("prob") >= threshold) & (key[0] == V.four_key(F.col("wanted"))[0])
    best = F.max(F.when(fit, F.struct(key.alias("key"), F.col("version"))))["version"]
    return rows.groupBy("page_id").agg(F.coalesce(best, F.max(F.struct(F.col("prob"), key.alias("key"), F.col("version")))["version"]).alias("version"))


def centred(rows: DataFrame) -> DataFrame:
    """(group, id, dot): each vector's offset from its group's mean along the mean's direction: sum of (v - mean) * mean."""
    long = rows.select("group", "id", F.posexplode("vector").alias("at", "x"))
    mean = long.groupBy("group", "at").agg(F.avg("x").alias("m"))
    return long.join(mean, ["group", "at"]).groupBy("group", "id").agg(F.sum((F.col("x") - F.col("m")) * F.col("m")).alias("dot"))


def _best(scored: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """(page_id, keys): of each page's candidates the one of best score, the first version of equal ones: version, score, hit; pool: whether any is expected."""
    ok = F.coalesce(V.matches(F.col("version"), F.col("expected")), F.lit(False))
    rows = scored.join(pages.select("page_id", "expected"), "page_id").withColumn("ok", ok)
    first = F.min_by(F.struct("version", "score", F.col("ok").alias("hit")), F.struct((-F.col("score")).alias("s"), "version"))
    return rows.groupBy("page_id", *keys).agg(first.alias("best"), F.max("ok").alias("pool")).select("page_id", *keys, "best.*", "pool")


def holdout(scored: DataFrame, pages: DataFrame) -> DataFrame:
    """(model, pages, hits, share, pool, pool_hits, pool_share): how often each model's best candidate is the expected version, of all pages and of those that have it among their candidates.

    scored: model, page_id, version, score; pages: page_id, expected. A page without
    candidates is a miss; a model without any gives no row.
    """
    total = pages.count()
    best = _best(scored, pages, "model").groupBy("model").agg(F.count_if("hit").alias("hits"), F.count_if("pool").alias("pool"), F.count_if(F.col("pool") & F.col("hit")).alias("pool_hits"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    n = F.lit(total).cast("long")
    return best.select("model", n.alias("pages"), "hits", share(F.col("hits"), n).alias("share"), "pool", "pool_hits", share(F.col("pool_hits"), F.col("pool")).alias("pool_share"))


def changes(scored: DataFrame, pages: DataFrame, old: str, new: str) -> DataFrame:
    """(page_id, expected, old_version, old_score, new_version, new_score, change): what two models choose; better, worse or same, by whether it is expected. Pages without candidates of both give no row."""
    of = lambda name, k: _best(scored.where(F.col("model") == name), pages).select("page_id", F.col("version").alias(f"{k}_version"), F.col("score").alias(f"{k}_score"), F.col("hit").alias(f"{k}_hit"))
    rows = of(old, "old").join(of(new, "new"), "page_id").join(pages.select("page_id", "expected"), "page_id")
    change = F.when(F.col("old_hit") == F.col("new_hit"), "same").when(F.col("new_hit"), "better").otherwise("worse")
    return rows.select("page_id", "expected", "old_version", "old_score", "new_version", "new_score", change.alias("change"))
