"""Pages with versions, made from the table part by SQL that Spark and DuckDB both read.

There are no version pages among the test tables; these have one kind of page for each
situation that the operators tell apart, by p_partkey % 12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_A, _B, _C = "CAST(p_size % 9 + 1 AS STRING)", "CAST(p_partkey % 20 AS STRING)", "CAST(p_partkey % 7 + 1 AS STRING)"
_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'alphatool' WHEN 1 THEN 'novakit' WHEN 2 THEN 'orbiter' ELSE 'pixelbox' END"
_V = f"concat({_A}, '.', {_B}, '.', {_C})"


def _older(k: int) -> str:
    return f"concat({_A}, '.', CAST((p_partkey % 20) + {k} AS STRING), '.', {_C})"


_HEAD = f"concat('<html><head><title>', {_NAME}, ' ', {{v}}, '</title><meta name=\"description\" content=\"Get ', {_NAME}, ' today\"></head><body><nav><a href=\"/about\">About</a></nav>')"
_LIST = "concat(" + ", ".join(f"'<h2>', {_NAME}, ' ', {_older(k)}, '</h2><p>This release fixes several bugs and improves speed for all of our users.</p>'" for k in range(5)) + ")"
_KINDS = [
    f"concat({_HEAD.format(v=_V)}, '<p>Version ', {_V}, ' is out now.</p><a href=\"/download/', {_NAME}, '-', {_V}, '.zip\">Download ', {_V}, '</a></body></html>')",
    f"concat({_HEAD.format(v=repr('news'))}, {_LIST}, '<a href=\"/download/', {_NAME}, '-', {_older(4)}, '.tar.gz\">Download</a></body></html>')",
    f"concat('Changes with ', {_NAME}, ' ', {_older(3)}, chr(10), 'Feature: first new thing in this one.', chr(10), 'Bugfix: second old thing.', chr(10), 'Changes with ', {_NAME}, ' ', {_older(1)}, chr(10), 'Feature: something older.', chr(10))",
    f"concat({_HEAD.format(v=repr('home'))}, '<svg viewBox=\"0 0 9.5 9.5\"><path d=\"M1.25 3.75\"/><text>', {_V}, '</text></svg><script>var buildNumber = \"7.8.9\";</script><style>p{{line-height: 1.35}}</style><p>Welcome to the page.</p></body></html>')",
    f"concat({_HEAD.format(v=_V)}, '<p>Licensed under the Apache 2.0 License . Server at 10.20.30.40 . Release ', {_V}, ' .</p></body></html>')",
    f"concat({_HEAD.format(v=repr('docs'))}, {_LIST}, '<ul><li>library 19.1.0</li><li>library 19.2.0</li></ul></body></html>')",
    f"concat({_HEAD.format(v=repr('2026.3'))}, '<p>Version 2026.3 and version ', {_V}, ' are here.</p></body></html>')",
    f"concat({_HEAD.format(v=repr('beta'))}, '<p>Download ', {_V}, '-rc2 or ', {_V}, '-beta1 today.</p></body></html>')",
    f"concat('{{\"name\": \"', {_NAME}, '\", \"version\": \"', {_V}, '\", \"minimumOsVersion\": \"15.1\"}}')",
    f"concat({_HEAD.format(v=repr('feed'))}, '<div id=\"root\"></div><a href=\"/notes/', {_NAME}, '-', {_V}, '/\">News</a><a href=\"/notes/', {_NAME}, '-', {_older(2)}, '/\">More</a></body></html>')",
    "''",
    "CAST(NULL AS STRING)",
]
_URLS = [
    f"concat('https://github.com/', {_NAME}, '/app', CAST(p_partkey % 5 AS STRING), '/releases')",
    f"concat('https://www.', {_NAME}, '.example.com/changelog')",
    f"concat('https://', {_NAME}, '.example.org:8080/feed/')",
    f"concat('https://api.github.com/repos/', {_NAME}, '/core/tags')",
    f"concat('https://raw.githubusercontent.com/', {_NAME}, '/docs/main/CHANGELOG.md')",
    f"concat('http://dl.', {_NAME}, '.example.net/news.rss?x=1')",
    f"concat('https://github.com/', {_NAME}, '/app/tags')",
    "'http://127.0.0.1/admin'",
]
_PICK = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KINDS))
COLUMNS = {
    "page_id": "p_partkey",
    "product": _NAME,
    "url": f"CASE p_partkey % 8 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_URLS))} END",
    "version": f"CASE p_partkey % 9 WHEN 0 THEN {_V} WHEN 1 THEN concat('v', {_V}) WHEN 2 THEN concat({_A}, '.', {_B}, 'rc2') WHEN 3 THEN concat({_A}, '.', {_B}, '-rc.2') WHEN 4 THEN '2026.3' WHEN 5 THEN concat({_V}, '.4') WHEN 6 THEN concat('v', {_A}, '.0+build5') WHEN 7 THEN concat({_V}, '-src.zip') ELSE CAST(p_partkey % 300 AS STRING) END",
    "stored": f"CASE p_partkey % 5 WHEN 0 THEN {_V} WHEN 1 THEN {_older(2)} WHEN 2 THEN '1.0' WHEN 3 THEN '' ELSE CAST(NULL AS STRING) END",
    "html": f"CASE p_partkey % 12 {_PICK} END",
}
SQL = "SELECT " + ", ".join(f"{x} AS {name}" for name, x in COLUMNS.items()) + " FROM part"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, product, url, version, stored, html, dealt by page: part is one small file, of which the pages are much more."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").selectExpr(*[f"{x} AS {name}" for name, x in COLUMNS.items()])
