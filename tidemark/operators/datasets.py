"""Datasets for training: merging, cleaning, labelling, pairing, splitting of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V


def draw(key: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 that a key and a seed decide: the first 13 hex digits of their MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), F.lit(13)), 16, 10).cast("double") / float(16**13)


def merged(corpora: DataFrame) -> DataFrame:
    """One row for each url of (url, ord, batch, name, expected): first values that aren't null or empty, batches joined."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    batches = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "batch"))), lambda x: x["batch"]), ",")
    return corpora.groupBy("url").agg(first("name").alias("name"), first("expected").alias("expected"), batches.alias("batches"))


def corrected(targets: DataFrame, fixes: DataFrame, removed: DataFrame) -> DataFrame:
    """targets (url, expected) with fixes (url, fixed) in place of their own, without removed (url)."""
    rows = targets.join(removed.select("url").distinct(), "url", "left_anti").join(fixes, "url", "left")
    return rows.select("url", F.coalesce("fixed", "expected").alias("expected"))


def deduplicated(annotations: DataFrame) -> DataFrame:
    """One row for each (page_id, version, label): distinct evidence, quotes joined to 300 characters, how many there were."""
    return annotations.groupBy("page_id", "version", "label").agg(
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"),
        F.substring(F.array_join(F.array_sort(F.collect_set("quote")), " | "), 1, 300).alias("quotes"), F.count("*").alias("dup_count"),
    )


def binary_label(label: Column) -> Column:
    """1 for current products, 0 for past and other ones, null if ambiguous."""
    return F.when(label == "current_product", 1).when(label.isin("historical_product", "non_product"), 0)


def settled(annotations: DataFrame) -> DataFrame:
    """annotations with ambiguous labels turned to non_product where the quote speaks of builds, licences or systems."""
    noise = F.col("quote").rlike("(?i)build|licen[sc]e|sdk|api|minimum|schema|protocol|css|svg")
    return annotations.withColumn("label", F.when((F.col("label") == "ambiguous") & noise, "non_product").otherwise(F.col("label")))


def graded(version: Column, expected: Column, historical: Column) -> Column:
    """2 for the expected version, 1 for one that matches it by prefix or is known as past, else 0."""
    return F.when(V.bare(version) == V.bare(expected), 2).when(V.matches(version, expected) | historical, 1).otherwise(0)


def with_target(rows: DataFrame) -> DataFrame:
    """Rows (page_id, label) of pages that have one of label 2."""
    return rows.withColumn("best", F.max("label").over(Window.partitionBy("page_id"))).where("best = 2").drop("best")


def split(rows: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.85), seed: int = 42) -> DataFrame:
    """rows with fold train, val or test; all rows of a key fall together."""
    x = draw(F.col(key).cast("string"), seed)
    return rows.withColumn("fold", F.when(x < shares[0], "train").when(x < shares[1], "val").otherwise("test"))


def capped_negatives(rows: DataFrame, per_positive: int = 3, seed: int = 42) -> DataFrame:
    """rows (url, version, label): all positives, and of each url's negatives at most so many for each positive, one at least, drawn by hash."""
    url = Window.partitionBy("url")
    ranked = rows.withColumns({"positives": F.sum(F.col("label")).over(url), "k": F.row_number().over(Window.partitionBy("url", "label").orderBy(draw(F.concat_ws(" ", "url", "version"), seed), "version"))})
    return ranked.where((F.col("label") == 1) | (F.col("k") <= F.greatest(F.col("positives") * per_positive, F.lit(1)))).select(rows.columns)


def pairs(rows: DataFrame, others: int = 3) -> DataFrame:
    """(page_id, pos, neg): each current version with all past ones of its page and the first so many non-products."""
    order = Window.partitionBy("page_id", "label").orderBy("version")
    ranked = rows.withColumn("k", F.row_number().over(order))
    pos = ranked.where("label = 'current_product'").select("page_id", F.col("version").alias("pos"))
    neg = ranked.where((F.col("label") == "historical_product") | ((F.col("label") == "non_product") & (F.col("k") <= others))).select("page_id", F.col("version").alias("neg"))
    return pos.join(neg, "page_id")


def evidence_choice(rows: DataFrame, least: int = 5) -> DataFrame:
    """(page_id, version, evidence, verdict): each page's version of most evidence, accept or review.

    rows: page_id, version, kind. A kind counts once for a version.
    """
    worth = {"structured": 10, "product-title": 9, "download": 6, "product-anchor": 6, "title": 5, "heading": 5, "meta": 3, "visible": 3}
    value = F.lit(0)
    for kind, w in worth.items():
        value = F.when(F.col("kind") == kind, w).otherwise(value)
    sums = rows.select("page_id", "version", "kind").distinct().groupBy("page_id", "version").agg(F.sum(value).alias("evidence"))
    order = Window.partitionBy("page_id").orderBy(F.desc("evidence"), F.desc(V.four_key(F.col("version"))), "version")
    one = sums.withColumn("k", F.row_number().over(order)).where("k = 1")
    return one.select("page_id", "version", "evidence", F.when(F.col("evidence") >= least, "accept").otherwise("review").alias("verdict"))


def canonical_versions(rows: DataFrame) -> DataFrame:
    """(page_id, version): the one left when dotted prefixes of others go; of several, the greatest if all have one major number; else null."""
    each = rows.select("page_id", "version").distinct()
    prefixes = each.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("version", r"\.")) - 1), lambda k: F.array_join(F.slice(F.split("version", r"\."), 1, k), "."))).alias("version")).where("version <> ''")
    left = each.join(prefixes.distinct(), ["page_id", "version"], "left_anti").withColumn("key", V.four_key(F.col("version")))
    agg = left.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct(F.col("key")[0]).alias("majors"), F.max_by("version", F.struct("key", "version")).alias("top"))
    return agg.select("page_id", F.when(F.col("majors") == 1, F.col("top")).alias("version"))


def first_annotation(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    """candidates (page_id, version) with the first annotation (page_id, ord, wanted, label) that matches by dotted prefix."""
    rows = candidates.join(annotations, "page_id").where(V.matches(F.col("version"), F.col("wanted")))
    order = Window.partitionBy("page_id", "version").orderBy("ord")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("page_id", "version", "wanted", "label")


def newest_projects(rows: DataFrame, n: int) -> DataFrame:
    """The first n projects with one row for each url: those with a pattern first, newest id first."""
    order = [F.desc(F.col("version_regex").isNotNull()), F.desc("id")]
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("k = 1").drop("k")
    return one.orderBy(*order).limit(n)
