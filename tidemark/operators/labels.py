"""Evidence for labels: noise, past versions, coverage of targets, tags of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V

# Contexts that can't be those of a product's version (drawings and styles,
# script assets, build and API fields, embedded SDKs).
STRONG_NOISE = [
    r"""(?i)(viewBox|path[ ]?d=|points=|d=["']M\d|font-size|line-height|\bfill[=:]|\bstroke[=:])""",
    r"""(?i)(\.js\?|\.css\?|\.min\.js|\.map\?|node_modules|webpack|chunk\.[0-9a-f]+|static\.parastorage|cdn|\.js["']|\.css["'])""",
    r"""(?i)(buildNumber\s*[:=]|build_number|sdkVersion\s*[:=]|apiVersion\s*[:=]|minimumOsVersion\s*[:=]|schemaVersion\s*[:=]|protocolVersion\s*[:=]|pkgVersion\s*[:=])""",
    r"""(?i)(window\._wpemojiSettings|RudderStack|analytics\._writeKey|parastorage|wixui)""",
]
# Words of product names that name no product.
GENERIC = (
    "news releases release release-notes history version notes note changelog app desktop mobile wiki blog page "
    "for and the of help support stable beta pro mac windows linux updates update"
).split()
# Scopes of the extractor in the words of the training data; others are noise.
TRAINING_SCOPES = {"url": "download-link", "changelog-url": "download-link", "structured": "structured", "json-ld": "structured", "changelog-header": "structured", "heading": "heading", "title": "visible", "body": "visible"}
# Tags of samples as the models were trained with.
TAGS = {"download": "下载链接中", "structured": "结构化字段", "noise": "噪声上下文", "major": "主版本号", "early": "预发布", "large": "大整数"}


def strong_noise(contexts: DataFrame) -> DataFrame:
    """(page_id, version): versions whose contexts (page_id, version, scope, text) are all noise, one of them of a telling kind."""
    telling = F.lit(False)
    for pattern in STRONG_NOISE:
        telling = telling | F.coalesce(F.col("text"), F.lit("")).rlike(pattern)
    found = contexts.groupBy("page_id", "version").agg(F.bool_and(F.col("scope").eqNullSafe("noise")).alias("noise"), F.bool_or(telling).alias("telling"))
    return found.where("noise and telling").select("page_id", "version")


def past_versions(contexts: DataFrame, current: DataFrame) -> DataFrame:
    """(page_id, version): versions other than the page's current one (page_id, current) that stand in the page itself and are no dates."""
    bare = V.bare(F.col("version"))
    seen = contexts.groupBy("page_id", "version").agg(F.bool_or(F.col("scope") != "noise").alias("shown")).where("shown")
    other = seen.join(current, "page_id").where(~V.matches(F.col("version"), F.col("current")))
    return other.where(~bare.rlike(r"^\d{4}([.-]\d{1,2})?$") & ~bare.rlike(r"^\d{4}[.-]\d{1,2}[.-]\d{1,2}")).select("page_id", "version")


def not_collected(trusted: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, missing): each page's trusted versions (page_id, version) that aren't among its candidates, in order, joined by /."""
    bare = lambda df: df.select("page_id", V.bare(F.col("version")).alias("bare")).distinct()
    missing = bare(trusted).join(bare(found), ["page_id", "bare"], "left_anti")
    return missing.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("bare")), "/").alias("missing"))


def uncovered(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages (page_id, expected) of which no candidate (page_id, version) matches what is expected."""
    covered = pages.join(found, "page_id").where(V.matches(F.col("version"), F.col("expected"))).select("page_id").distinct()
    return pages.join(covered, "page_id", "left_anti")


def with_rendered(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Static candidates, then those of the rendered page (page_id, version, ord, scope) whose version isn't there yet; source tells which."""
    new = rendered.join(static.select("page_id", "version").distinct(), ["page_id", "version"], "left_anti")
    first = new.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "version").orderBy("ord"))).where("k = 1").drop("k")
    return static.withColumn("source", F.lit("static")).unionByName(first.withColumn("source", F.lit("l2-render")))


def samples(*buckets: DataFrame) -> DataFrame:
    """All label buckets as one set, with the columns of the first."""
    out = buckets[0]
    for more in buckets[1:]:
        out = out.unionByName(more.select(out.columns))
    return out


def choices(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """(page_id, trusted, version): candidates that are a trusted version (page_id, trusted) or a deeper one of it."""
    own, of = V.bare(F.col("version")), V.bare(F.col("trusted"))
    return found.join(trusted, "page_id").where((own == of) | F.startswith(own, F.concat(of, F.lit(".")))).select("page_id", "trusted", "version").distinct()


def page_list(targets: DataFrame, rows: DataFrame, html: DataFrame, removed: DataFrame) -> DataFrame:
    """(page_id, url, expected, past, reason): target pages that aren't removed (url), with the set of their past versions; reason missing-html where there is no html.

    targets: page_id, url, expected; rows: page_id, version, label; html: page_id, html.
    """
    past = rows.where("label = 'historical_product'").groupBy("page_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("v"), V.bare(F.col("version"))))).alias("past"))
    out = targets.join(removed.select("url").distinct(), "url", "left_anti").join(past, "page_id", "left")
    has = html.where("html <> ''").select("page_id", F.lit(True).alias("has"))
    out = out.join(has, "page_id", "left")
    return out.select("page_id", "url", "expected", F.coalesce("past", F.array().cast("array<string>")).alias("past"), F.when(F.col("has").isNull(), "missing-html").alias("reason"))


def tagged(text: Column, version: Column, scopes: Column) -> Column:
    """A sample's text with the tags that its version and scopes call for."""
    bare = F.regexp_replace(version, "^[vV]+", "")
    tags = F.array_compact(F.array(
        F.when(F.array_contains(scopes, "download-link"), TAGS["download"]), F.when(F.array_contains(scopes, "structured"), TAGS["structured"]),
        F.when(F.array_contains(scopes, "noise") & (F.size(scopes) == 1), TAGS["noise"]), F.when(bare.rlike(r"^\d{1,2}$"), TAGS["major"]),
        F.when(version.rlike("rc|beta|alpha|pre"), TAGS["early"]), F.when(bare.rlike(r"^\d{4,}$"), TAGS["large"]),
    ))
    return F.when(F.size(tags) > 0, F.concat(F.substring(text, 1, 460), F.lit(" [特征: "), F.array_join(tags, ", "), F.lit("]"))).otherwise(text)


def basic_plane(text: Column) -> Column:
    """text without characters beyond the basic plane."""
    return F.regexp_replace(text, r"[^\x{0}-\x{FFFF}]", "")


def product_terms(name: Column) -> Column:
    """A product's name without versions and brackets, then its words of three letters or more that aren't generic."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"v?\d+(\.\d+)*", " "), r"[|–—·():\[\]{}]", " "), r"\s+", " "))
    words = F.filter(F.split(text, " "), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC))
    return F.array_distinct(F.filter(F.concat(F.array(text), words), lambda w: w != ""))


def live_value(raw: Column) -> Column:
    """What a user's pattern gave, as a version; null if it is too long, a hash, or has no digit."""
    t = F.trim(raw)
    return F.when(t.rlike(r"\d") & ~t.rlike("(?i)^[0-9a-f]{16,}$") & (F.length(t) <= 30), V.normalized(t))


def training_scope(scope: Column) -> Column:
    """A scope in the words of the training data."""
    out = F.lit("noise")
    for own, theirs in TRAINING_SCOPES.items():
        out = F.when(scope == own, theirs).otherwise(out)
    return out


def sequence_rates(rows: DataFrame) -> DataFrame:
    """One row: cases (latest, expected) hit, wrong and missed, the share hit, and the share of right answers among all given."""
    hit = F.col("latest").isNotNull() & V.matches(F.col("latest"), F.col("expected"))
    sums = rows.where("expected <> ''").agg(F.count_if(hit).alias("hit"), F.count_if(F.col("latest").isNotNull() & ~hit).alias("wrong"), F.count_if(F.col("latest").isNull()).alias("missed"))
    return sums.select("hit", "wrong", "missed", (F.col("hit") / F.nullif(F.expr("hit + wrong + missed"), F.lit(0))).alias("hit_rate"), (F.col("hit") / F.nullif(F.expr("hit + wrong"), F.lit(0))).alias("precision"))
