"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histograms of character classes and of its language's commonest words are
compared with the language's own, counted over all documents, by Jensen-Shannon
distance (base 2: from 0 to 1). Words outside the common ones share a bin, so a text
without common words isn't far from its language; how far such a text is scales the
limit of texts that have fewer common words than their language. Short texts, whose
histograms say little, are let through by a guard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import table

#: Frequent function words, by language.
COMMON_WORDS = {
    "en": "the of and to in is that for on was with be by this it as".split(),
    "de": "der die und in den von zu das mit des auf für ist im dem ein".split(),
    "es": "de la que el en y a los se del las un por con una es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
}
#: Character classes, as the inside of a Java character class; what is left is the last class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": "\\x20\\x09-\\x0D", "stop": ".,;:!?'\"()\\-", "symbol": "#*$%&|<>=+/\\\\^~@_`{}\\[\\]"}
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45
#: Of the distance of a text without common words; holds where a text should have so many.
MAX_ABSENCE, MIN_EXPECTED = 0.8, 10
SPACE = " \t\n\x0b\f\r"
#: Places of words fit into so many bits beside a window's hash.
PLACE_BITS = 20


def _windows(hash_at, size: Column) -> Column:
    return F.when(size > 3, F.transform(F.sequence(F.lit(0), size - 3), hash_at)).otherwise(F.array().cast("array<bigint>"))


def _among(words: list[str]):
    return lambda x: F.lower(x).isin(words)


def _counts(docs: DataFrame) -> DataFrame:
    """The contract's counts and the histograms of each row, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("trimmed"))
    base = base.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[\\x20\\x09-\\x0D]+"))).drop("trimmed")
    base = base.withColumn("n", F.size("words")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))

    def window(i: Column) -> Column:
        return F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))

    # windows sorted by most of their hash, with their places; those beside an equal one may occur twice
    mask = (1 << PLACE_BITS) - 1
    packed = F.when(F.col("n") <= mask, _windows(lambda i: F.shiftleft(window(i), PLACE_BITS).bitwiseOR(i.cast("long")), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("packed", F.sort_array(packed))

    def alike(x: Column, i: Column) -> Column:
        return (F.shiftright(x, PLACE_BITS) == F.shiftright(F.get("packed", i + 1), PLACE_BITS)) | ((i > 0) & (F.shiftright(x, PLACE_BITS) == F.shiftright(F.get("packed", i - 1), PLACE_BITS)))

    near = F.transform(F.filter("packed", lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    base = base.withColumn("near", F.when(F.col("n") <= mask, near).otherwise(F.sequence(F.lit(0), F.col("n") - 3)))
    # the same by whole hashes, for the few places left
    base = base.withColumn("exact", F.when(F.size("near") > 0, F.sort_array(F.transform("near", lambda i: F.struct(window(i).alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter("exact", lambda x, i: F.coalesce((x["h"] == F.get("exact", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("exact", i - 1)["h"])), F.lit(False)))
    base = base.withColumn("places", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("places", lambda p, i: F.coalesce(F.least(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)

    def chars(c: str) -> Column:
        return F.length(F.regexp_replace("text", f"[^{c}]+", ""))

    # the common words alone, then each counted among them
    common = F.array().cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.filter("words", _among(words))).otherwise(common)
    base = base.withColumn("spread", F.concat(F.lit(" "), F.lower(F.array_join(common, "  ")), F.lit(" ")))

    def count_of(w: str) -> Column:
        return ((F.length("spread") - F.length(F.replace("spread", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int")

    hits = F.lit(None).cast("array<int>")
    for lang, words in COMMON_WORDS.items():
        hits = F.when(F.col("lang") == lang, F.array(*[count_of(w) for w in words])).otherwise(hits)
    return base.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), chars("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"), F.array(*[chars(c) for c in CLASSES.values()]).alias("classes"), hits.alias("hits"),
    )


def _with_rest(counts: str, total: str) -> Column:
    """The counts and what they leave of the total."""
    rest = F.greatest(F.lit(0), F.col(total) - F.aggregate(counts, F.lit(0), lambda s, x: s + x).cast("long"))
    return F.concat(F.col(counts).cast("array<double>"), F.array(rest.cast("double")))


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; of an empty one 0."""
    total, all_of = (F.aggregate(x, F.lit(0.0), lambda s, c: s + c) for x in (counts, reference))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2 / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(q * 2 / (p + q))).otherwise(0.0)

    parts = F.aggregate(F.zip_with(counts, reference, lambda c, r: part(c / total, r / all_of)), F.lit(0.0), lambda s, x: s + x)
    return F.when((total > 0) & (all_of > 0), F.sqrt(F.greatest(parts / 2, F.lit(0.0)))).otherwise(0.0)


def _absent(reference: list[float]) -> float:
    """Distance from the reference of a text without common words, as _distance has it."""
    rest = reference[-1] / (sum(reference) or 1)
    return math.sqrt(max(0.0, (math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0.0) + 1 - rest) / 2))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance.

    A null text is an empty one; it, like any text of under 50 words, fails the base
    rules. A text in a language without reference is held against the nearest language's
    character classes only. Where no text of any language is there to refer to, distances
    are 0. Each row is judged alone; columns other than doc_id, text and lang aren't read.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    rows = table(_counts(docs))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumns({"base_failed": base_failed, "all_classes": _with_rest("classes", "n_chars"), "all_hits": _with_rest("hits", "n_words")})
    kinds = {"all_classes": len(CLASSES) + 1, "all_hits": len(next(iter(COMMON_WORDS.values()))) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in kinds.items() for i in range(n)]
    found = sorted(rows.where(F.col("lang").isin(list(COMMON_WORDS)) & ~F.col("base_failed")).groupBy("lang").agg(*sums).collect())
    # one row of sums for each language with common words
    classes, words = ([F.array(*[F.lit(float(r[f"{c}{i}"] or 0)) for i in range(n)]) for r in found] for c, n in kinds.items())
    near = [_distance(F.col("all_classes"), x) for x in classes]
    nearest = F.least(*near) if len(near) > 1 else near[0] if near else F.lit(0.0)
    own_classes, own_words = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    share, absent = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r, x, y in zip(found, classes, words, strict=True):
        sums_of = [float(r[f"all_hits{i}"] or 0) for i in range(kinds["all_hits"])]
        common = sum(sums_of[:-1]) / (sum(sums_of) or 1)
        share, absent = F.when(F.col("lang") == r["lang"], F.lit(common)).otherwise(share), F.when(F.col("lang") == r["lang"], F.lit(_absent(sums_of))).otherwise(absent)
        own_classes, own_words = F.when(F.col("lang") == r["lang"], x).otherwise(own_classes), F.when(F.col("lang") == r["lang"], y).otherwise(own_words)
    rows = rows.withColumns({"own_classes": own_classes, "own_words": own_words})
    rows = rows.withColumn("class_distance", F.when(F.col("own_classes").isNotNull(), _distance(F.col("all_classes"), F.col("own_classes"))).otherwise(nearest))
    rows = rows.withColumn("word_distance", F.when(F.col("own_words").isNotNull(), _distance(F.col("all_hits"), F.col("own_words"))).otherwise(0.0))
    expected, rest = F.col("n_words") * share, F.element_at("all_hits", -1)
    fewer = (expected >= MIN_EXPECTED) & (F.col("n_words") - rest < expected) & (F.col("word_distance") > absent * MAX_ABSENCE)
    far = (F.col("word_distance") > MAX_WORD_DISTANCE) | F.coalesce(fewer, F.lit(False))
    bad = ((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & far)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "class_distance", "word_distance")
