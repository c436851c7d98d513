"""Version strings: normal forms, sort keys and predicates, as Column expressions.

A sort key is an array of longs, which Spark compares element by element. Five orders
are in use; they differ in what they do with suffixes and with a fourth number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGS = "array<bigint>"


def bare(v: Column) -> Column:
    """Without a leading v."""
    return F.regexp_replace(v, "^[vV]", "")


def normalized(v: Column) -> Column:
    """Trimmed, with a v in front unless there is one."""
    t = F.trim(v)
    return F.when(t.rlike("^[vV]"), t).otherwise(F.concat(F.lit("v"), t))


def canonical(v: Column) -> Column:
    """Trimmed, all leading v's replaced by one."""
    return F.concat(F.lit("v"), F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), "^[vV]+", ""))


def purified(v: Column) -> Column:
    """The first run of up to four numbers with a pre-release mark; file suffixes go. The text itself if it has none."""
    found = F.regexp_extract(v, r"(?i)v?\d+(?:\.\d+){0,3}(?:[-.]?(?:alpha|beta|rc|pre|dev|patch)\d*)?", 0)
    return F.when(found == "", v).otherwise(found)


def _padded(numbers: Column, n: int) -> Column:
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), n)), 1, n)


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), 0), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))


def three_key(v: Column) -> Column:
    """Three numbers at most; anything after - or + is ignored, text in a segment counts as far as its digits go."""
    base = F.regexp_replace(F.regexp_replace(bare(F.coalesce(v, F.lit(""))), "(?s)-.*$", ""), r"(?s)\+.*$", "")
    return _padded(F.transform(F.split(base, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0))), 3)


def four_key(v: Column) -> Column:
    """The first four runs of digits before any + or -."""
    return _padded(F.slice(_numbers(F.regexp_extract(bare(v), "^[^+-]*", 0)), 1, 4), 4)


#: Pre-release marks by rank; a release ranks 6.
PRE_RANK = {"dev": 1, "pre": 2, "patch": 2, "alpha": 3, "beta": 4, "rc": 5}
_PRE = r"(?i)(?:^|[.-])(alpha|beta|rc|pre|dev|patch)(\d*)"


def _before_plus(v: Column) -> Column:
    return F.regexp_extract(bare(v), r"^[^+]*", 0)


def evolution_numbers(v: Column) -> Column:
    """Up to four numbers, padded to four, pre-release marks after a separator left out."""
    return _padded(F.slice(_numbers(F.regexp_replace(_before_plus(v), r"(?i)(?:^|[.-])(?:alpha|beta|rc|pre|dev|patch)\d*", "")), 1, 4), 4)


def segments(v: Column) -> Column:
    """How many numbers a version has, pre-release marks left out."""
    return F.size(_numbers(F.regexp_replace(_before_plus(v), r"(?i)(?:^|[.-])(?:alpha|beta|rc|pre|dev|patch)\d*", "")))


def evolution_key(v: Column) -> Column:
    """Four numbers, the rank of the pre-release mark, its number."""
    mark = F.lower(F.regexp_extract(_before_plus(v), _PRE, 1))
    rank = F.lit(6)
    for name, r in PRE_RANK.items():
        rank = F.when(mark == name, r).otherwise(rank)
    number = F.coalesce(F.regexp_extract(_before_plus(v), _PRE, 2).try_cast("bigint"), F.lit(0))
    return F.concat(evolution_numbers(v), F.array(rank.cast("bigint"), number))


def semver_key(v: Column) -> Column:
    """The first one to three dotted numbers anywhere in the text."""
    return _padded(_numbers(F.regexp_extract(v, r"\d+(?:\.\d+){0,2}", 0)), 3)


def prompt_key(v: Column) -> Column:
    """Four segments, those that aren't numbers 0; used in falling order."""
    return _padded(F.slice(F.transform(F.split(bare(v), r"\."), lambda x: F.coalesce(F.when(x.rlike(r"^\d+$"), x).try_cast("bigint"), F.lit(0))), 1, 4), 4)


def key_text(key: Column) -> Column:
    return F.array_join(key.cast("array<string>"), ".")


def suspicious(v: Column) -> Column:
    """All zeros, a second number of 1000 or third of 10000 up, or a bare single one of 100 up."""
    n = F.transform(F.split(bare(v), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint"), F.lit(0)))
    return F.forall(n, lambda x: x == 0) | (F.coalesce(F.get(n, F.lit(1)), F.lit(0)) >= 1000) | (F.coalesce(F.get(n, F.lit(2)), F.lit(0)) >= 10000) | ((F.size(n) == 1) & ~v.startswith("v") & (F.get(n, F.lit(0)) >= 100))


def sequence_member(v: Column) -> Column:
    """First number from 1 to 99."""
    return F.coalesce(F.regexp_extract(v, r"^\d+", 0).try_cast("bigint").between(1, 99), F.lit(False))


def date_like(v: Column) -> Column:
    """First number from 1900 to 2100."""
    return F.coalesce(F.regexp_extract(bare(v), r"^\d+", 0).try_cast("bigint").between(1900, 2100), F.lit(False))


def yearish(v: Column) -> Column:
    return bare(v).rlike(r"^\d{4}([.-]\d{1,2}){1,2}$")


def iso_date(v: Column) -> Column:
    return v.rlike(r"^v?\d{4}[-.]\d{2}[-.]\d{2}$")


def clean(v: Column) -> Column:
    """One to four numbers and nothing else before - or +."""
    return F.regexp_extract(bare(v), "^[^+-]*", 0).rlike(r"^\d+(\.\d+){0,3}$")


def suggested_pattern(v: Column) -> Column:
    n = F.size(F.split(bare(v), r"\."))
    return F.when(n >= 3, r"v?(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?)").when(n == 2, r"v?(\d+\.\d+)").otherwise(r"v?(\d+)")


def download_url(u: Column) -> Column:
    return u.rlike(r"(?i)\.(?:zip|dmg|exe|msi|tar\.gz|tar\.bz2|tgz|deb|rpm|apk|pkg|7z)(?:\?|#|$)|/downloads?/|/releases?/|/ftp/|/dl/")


def matches(a: Column, b: Column) -> Column:
    """Equal, or one is a dotted prefix of the other."""
    x, y = bare(a), bare(b)
    return (x == y) | F.startswith(x, F.concat(y, F.lit("."))) | F.startswith(y, F.concat(x, F.lit(".")))


def matches_prefix(actual: Column, expected: Column) -> Column:
    """Equal to what is expected, or deeper."""
    x, y = bare(actual), bare(expected)
    return (x == y) | F.startswith(x, F.concat(y, F.lit(".")))


def cross_check(found: Column, stored: Column) -> Column:
    """update, equal, downgrade or incomparable."""
    a, b = three_key(found), three_key(stored)
    return F.when(found.isNull() | stored.isNull() | (stored == ""), "incomparable").when(a > b, "update").when(a == b, "equal").otherwise("downgrade")


def trusted(found: Column, stored: Column, confidence: Column) -> Column:
    """Whether a find may be stored without review."""
    verdict = cross_check(found, stored)
    return F.coalesce((confidence == "high") & ((verdict == "update") | ((verdict == "incomparable"))), F.lit(False))
