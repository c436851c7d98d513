"""Version lines: candidates of a page joined to families by how their numbers follow each other.

In the order of versions, neighbours one and two places apart are joined if their numbers
continue; a family is what joins lead to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from ..plans.tables import joined, written

#: Fixed values.
EDGE, CONTINUITY, ANCHORED, LOOSE, NEAR_TIE = 0.58, 0.72, 0.08, 0.03, 0.15
STRONG = ("download-link", "title", "structured", "heading")
MIN_PROB, RESCUE_PROB = 0.3, 0.1


def eligible(scored: DataFrame) -> DataFrame:
    """Candidates of more than 0.3 that aren't dates."""
    return scored.where((F.col("prob") > MIN_PROB) & ~V.iso_date(F.col("version")))


def nodes(scored: DataFrame) -> DataFrame:
    """scored (page_id, version, prob, scopes, path) with number, key, segments and anchored."""
    v = F.col("version")
    strong = F.arrays_overlap("scopes", F.array(*[F.lit(s) for s in STRONG]))
    rows = scored.withColumns({"key": V.evolution_key(v), "segments": V.segments(v), "yearish": V.yearish(v), "anchored": F.coalesce(strong, F.lit(False))})
    rows = rows.withColumns({"major": F.col("key")[0], "minor": F.col("key")[1]})
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("page_id").orderBy("key", "version")))


def _continuity(x: Column, y: Column) -> Column:
    """How far y's numbers go on from x's."""
    short_minor = F.when(x["segments"] == 2, x["minor"]).otherwise(y["minor"])
    apart = F.abs(x["segments"] - y["segments"])
    next_major = F.when(apart == 0, 0.85).when((apart == 1) & (short_minor == 0), 0.72).otherwise(0.0)
    return F.when(x["major"] == y["major"], 1.0).when(F.abs(x["major"] - y["major"]) == 1, next_major).otherwise(0.0)


def edges(found: DataFrame) -> DataFrame:
    """found, as nodes() gives it, with joins: those of the next two places that a row is joined to. Windows of a page only, so that rows are shuffled once."""
    page = Window.partitionBy("page_id").orderBy("i")
    of_major = Window.partitionBy("page_id", "major")
    times = F.when(F.col("path").isNotNull(), F.count("*").over(Window.partitionBy("page_id", "major", "path")))
    main = F.first("path").over(of_major.orderBy(F.desc_nulls_last("times"), "path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = found.withColumn("times", times).withColumns({"members": F.count("*").over(of_major), "main": main})
    me = F.struct("i", "major", "minor", "segments", "yearish", "anchored", "members", "main")
    rows = rows.withColumn("x", me).withColumns({"y1": F.lead("x", 1).over(page), "y2": F.lead("x", 2).over(page)})

    def goes_on(y: str) -> Column:
        x, y = F.col("x"), F.col(y)
        steps = _continuity(x, y)
        weight = F.when((x["yearish"] != y["yearish"]) | (steps == 0), 0.0).otherwise(F.least(F.lit(1.0), steps * CONTINUITY + LOOSE + F.when(x["anchored"] & y["anchored"], ANCHORED).otherwise(0.0)))
        alike = x["main"].isNull() | y["main"].isNull() | (x["main"] == y["main"])
        backed = (x["segments"] == y["segments"]) | (F.least(x["members"], y["members"]) >= 2)
        return F.when(y.isNotNull() & (weight >= EDGE) & ((x["major"] == y["major"]) | (alike & backed)), y["i"])

    joins = F.filter(F.array(goes_on("y1"), goes_on("y2")), lambda b: b.isNotNull())
    return rows.withColumn("joins", joins).drop("times", "members", "main", "x", "y1", "y2")


def families(scored: DataFrame) -> DataFrame:
    """nodes() with family: the place of its smallest member.

    Labels are merged along each page's own joins, in one array per page.
    """
    found = nodes(scored)
    own = F.array_sort(F.collect_list(F.struct("i", *[c for c in found.columns if c not in ("page_id", "i")], "joins")))
    per = edges(found).groupBy("page_id").agg(own.alias("own"))
    joins = F.flatten(F.transform("own", lambda x: F.transform(x["joins"], lambda b: F.struct(x["i"].alias("a"), b.alias("b")))))

    def merged(labels: Column, e: Column) -> Column:
        x, y = F.get(labels, e["a"] - 1), F.get(labels, e["b"] - 1)
        return F.transform(labels, lambda z: F.when(z == F.greatest(x, y), F.least(x, y)).otherwise(z))

    label = F.aggregate(joins, F.transform("own", lambda x: x["i"]), merged)
    rows = per.select("page_id", "own", label.alias("label")).select("page_id", F.explode(F.arrays_zip("own", "label")).alias("x"))
    return rows.select("page_id", *[F.col(f"x.own.{c}").alias(c) for c in found.columns if c != "page_id"], F.col("x.label").alias("family"))


def family_stats(members: DataFrame) -> DataFrame:
    """(page_id, family, size, density, trajectory, latest, latest_prob, score) of families()."""
    agg = members.groupBy("page_id", "family").agg(
        F.count("*").alias("size"), F.count_distinct("major", "minor").alias("bases"), F.avg("prob").alias("mean"), F.avg(F.col("anchored").cast("double")).alias("share"),
        F.max(F.struct("key", "version", "prob")).alias("last"),
    )
    density, trajectory = F.col("size") / F.col("bases"), F.least(F.lit(1.0), (F.col("size") + F.col("bases")) / 12)
    score = F.log1p("size") * 1.5 + F.least(density, F.lit(3.0)) * 0.5 + trajectory * 1.8 + F.col("mean") * 0.45 + F.col("share") * 0.25 + F.col("last.prob") * 0.35 - F.when(F.col("size") == 1, 1.5).otherwise(0.0)
    return agg.select("page_id", "family", "size", density.alias("density"), trajectory.alias("trajectory"), F.col("last.version").alias("latest"), F.col("last.prob").alias("latest_prob"), score.alias("score"))


def selected(scored: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(page_id, version, prob, family_size): the greatest version of each page's best family.

    Families with a product hit (page_id, version) gain 3, those of one 1.2 less; of those
    within 0.15 of the best, the larger and then longer one wins. That rule takes the best
    score as its fixed point, as nearness isn't transitive. Less probable candidates of a
    member's major number may still be the greatest.
    """
    members = written(families(eligible(scored)).select("page_id", "version", "prob", "key", "major", "minor", "anchored", "family"))
    stats = family_stats(members)
    if hits is not None:
        named = joined(members.withColumn("bare", V.bare(F.col("version"))), hits.select("page_id", V.bare(F.col("version")).alias("bare")).distinct(), ["page_id", "bare"])
        named = named.select("page_id", "family").distinct().withColumn("named", F.lit(3.0))
        stats = joined(stats, named, ["page_id", "family"], "left")
    else:
        stats = stats.withColumn("named", F.lit(0.0))
    total = F.col("score") + F.coalesce("named", F.lit(0.0)) - F.when(F.col("size") == 1, 1.2).otherwise(0.0)
    page = Window.partitionBy("page_id")
    # sums of doubles differ in their last digits by the order of rows: those don't decide
    near = stats.withColumn("total", F.round(total, 9)).withColumn("gap", F.round(F.max("total").over(page) - F.col("total"), 9)).where(F.col("gap") <= NEAR_TIE)
    best = near.withColumn("k", F.row_number().over(page.orderBy(F.desc("size"), F.desc("trajectory"), F.desc("total"), "family"))).where("k = 1").select("page_id", "family", "size")
    inside = joined(members, best, ["page_id", "family"])
    majors = inside.select("page_id", "major", "size").distinct()
    rest = scored.where((F.col("prob") > RESCUE_PROB) & ~V.yearish(F.col("version"))).withColumn("key", V.evolution_key(F.col("version")))
    rest = joined(rest.withColumn("major", F.col("key")[0]), majors, ["page_id", "major"]).select("page_id", "version", "prob", "key", "size")
    pool = inside.select("page_id", "version", "prob", "key", "size").unionByName(rest).distinct()
    top = pool.groupBy("page_id").agg(F.max(F.struct("key", "version", "prob", "size")).alias("p"))
    return top.select("page_id", "p.version", "p.prob", F.col("p.size").alias("family_size"))


def selected_by_seed(scored: DataFrame) -> DataFrame:
    """(page_id, version, margin, strong): the greatest version of the family of each page's seed.

    scored has score besides. A seed alone in its family without a strong scope gives no row.
    """
    from .features import seeds

    valid = eligible(scored)
    seed = seeds(valid).select("page_id", F.col("version").alias("seed"), "margin")
    members = families(valid)
    own = joined(members, seed, "page_id").where("version = seed").select("page_id", "family", "margin", F.col("anchored").alias("strong_scope"))
    stats = family_stats(members).select("page_id", "family", "size", "latest")
    rows = joined(own, stats, ["page_id", "family"]).where("size > 1 or strong_scope")
    return rows.select("page_id", F.col("latest").alias("version"), "margin", (F.col("strong_scope") | (F.col("size") > 1)).alias("strong"))
