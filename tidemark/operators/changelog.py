"""Changelog text of one version: sections of plain text, Markdown and HTML pages.

Inputs have page_id and a text column; target is the wanted version, null for the newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import html as H
from ..functions import text as T
from ..functions import versions as V
from ..plans.tables import joined, written

_HEADER = r"(?i)(?:Changes?\s+with\s+[^\s]+\s+|Changelog\s+(?:with\s+[^\s]+\s+)?|(?:^|\s)(?:v|version\s+)?)(\d+(?:\.\d+){1,3})(?=\s|$)"


def _lines(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("page_id", "target", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))


def plain_sections(rows: DataFrame, text: str = "text") -> DataFrame:
    """(page_id, version, title, date, content): the lines after the target's header, or the greatest version's, up to the next header.

    Pages without a header, or with nothing under it, give no row.
    """
    lines = _lines(rows, text).withColumn("v", F.nullif(F.regexp_extract("line", _HEADER, 1), F.lit("")))
    page = Window.partitionBy("page_id")
    headers = lines.where("v is not null").withColumn("hit", F.coalesce(F.col("v") == V.bare(F.col("target")), F.lit(False)))
    first = F.row_number().over(page.orderBy(F.desc("hit"), F.when(F.col("hit"), F.col("pos")), F.desc(V.three_key(F.col("v"))), "pos"))
    start = headers.withColumn("k", first).where("k = 1").select("page_id", F.col("pos").alias("start"), F.col("v").alias("version"), F.col("line").alias("title"))
    after = joined(lines, start, "page_id").where("pos > start")
    stop = after.where("v is not null and line <> title").groupBy("page_id").agg(F.min("pos").alias("stop"))
    inside = joined(after, stop, "page_id", "left").where("(stop is null or pos < stop) and line <> ''")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = inside.groupBy("page_id", "version", "title").agg(content.alias("content"))
    return found.select("page_id", V.canonical(F.col("version")).alias("version"), "title", T.date_in(F.col("title")).alias("date"), "content")


def markdown_sections(rows: DataFrame, text: str = "text") -> DataFrame:
    """(page_id, version, title, date, content): the section of the target's heading, or of the first with a version.

    A section ends at the next heading of its level or above. Lines in fenced code are no
    headings. Pages without such a heading, or with an empty section, give no row.
    """
    # running windows of one order: lines are made and shuffled once, and no side of a join can be broadcast by a guess
    so_far = Window.partitionBy("page_id").orderBy("pos")
    lines = _lines(rows, text)
    fences = F.sum(F.col("line").startswith("```").cast("int")).over(so_far)
    lines = lines.withColumn("level", F.when(fences % 2 == 0, F.nullif(F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)), F.lit(0))))
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"[*_`]|\s+#+$", ""))
    lines = lines.withColumn("title", F.when(F.col("level").isNotNull(), title))
    lines = lines.withColumn("v", F.nullif(F.regexp_extract("title", r"v?(\d+(?:\.\d+){1,3})", 1), F.lit("")))
    heading = F.when(F.expr("v is not null and (target is null or v = regexp_replace(target, '^[vV]+', ''))"), F.struct("pos", "level", "title", "v"))
    after = lines.withColumn("h", F.first(heading, ignorenulls=True).over(so_far)).withColumn("past", F.col("pos") > F.col("h.pos"))
    ended = F.coalesce(F.max(F.expr("past and level <= h.level")).over(so_far), F.lit(False))
    inside = after.withColumn("ended", ended).where("past and not ended")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    found = inside.groupBy("page_id", "h").agg(T.tidy(F.regexp_replace(content, r"^\n+|\n+$", "")).alias("content")).where("content <> ''")
    return found.select("page_id", V.canonical(F.col("h.v")).alias("version"), F.col("h.title").alias("title"), F.nullif(F.regexp_extract("h.title", r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1), F.lit("")).alias("date"), "content")


_BLOCK = r"(?i)<(?:p|div|li|ul|ol|h[1-6]|blockquote|pre|section)\b[^>]*>"


def _blocks(html: Column) -> Column:
    return F.transform(F.split(html, _BLOCK, -1), lambda b, i: F.struct(i.alias("i"), T.section_text(b).alias("raw")))


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\x{4E00}-\x{9FFF}]+"), 0))


def densest_block(html: Column) -> Column:
    """Text of the block of most words, if ten or more; the first of equal ones."""
    ranked = F.transform(_blocks(html), lambda b: F.struct(_words(b["raw"]).alias("n"), (-b["i"]).alias("i"), b["raw"].alias("raw")))
    best = F.array_max(ranked)
    content = T.clean_text(best["raw"])
    return F.when((best["n"] >= 10) & (F.length(content) > 20), content)


def first_dense_block(html: Column) -> Column:
    """Text of the first block of five words or more that isn't a breadcrumb."""
    anchors = lambda b: F.size(F.regexp_extract_all(b, F.lit("<a[^>]+>"), 0))
    kept = F.filter(_blocks(html), lambda b: (_words(b["raw"]) >= 5) & ~((anchors(b["raw"]) >= 3) & (_words(b["raw"]) <= anchors(b["raw"]) * 2)) & (F.length(T.clean_text(b["raw"])) > 20))
    return T.clean_text(F.get(kept, F.lit(0))["raw"])


def target_section(html: Column, target: Column) -> Column:
    """The HTML from the element whose id holds the target up to the next element with a version id; null if none."""
    quoted = F.regexp_replace(V.bare(target), r"([.+*?^$(){}|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit(r"""(?is)<[a-z0-9]+\b[^>]*\bid=["']?[^"'\s>]*"""), quoted, F.lit(r"""[^"'\s>]*["']?[^>]*>.*?(?=<[a-z0-9]+\b[^>]*\bid=["']?v?\d+(?:\.\d+){1,3}["']?[^>]*>|\z)"""))
    section = F.nullif(F.regexp_substr(html, pattern), F.lit(""))
    article = F.regexp_extract(section, "(?is)<article.*?</article>", 0)
    return F.when(article != "", article).otherwise(section)


def container_text(html: Column) -> Column:
    """Text from the first element of a content class on, 30,000 characters at most; null if 80 or fewer."""
    place = F.regexp_instr(html, F.lit(r"""(?i)<[a-z][a-z0-9]*\b[^>]*class=["'][^"']*(?:typeset|post-content|article-content|entry-content|markdown-body|content-body|prose|readme)[^"']*["'][^>]*>"""))
    found = T.clean_text(T.section_text(F.substr(html, place, F.lit(30_000))))
    return F.when((place > 0) & (F.length(found) > 80), found)


def changelogs(pages: DataFrame) -> DataFrame:
    """(page_id, version, content, language, kind, confidence): the best changelog text of each page, or none.

    In order: the target's own section, a content container, a plain-text section, the
    article, text after the target's heading, the densest block. What is no changelog by
    its content is left out, as are pages drawn by scripts. pages: page_id, html, target.
    """
    rows = pages.select("page_id", "target", F.coalesce("html", F.lit("")).alias("html")).withColumn("kind", T.changelog_kind(F.col("html")))
    plain = plain_sections(rows.where("kind = 'plain-text'").select("page_id", "target", "html"), "html").select("page_id", F.col("version").alias("plain_version"), F.col("content").alias("plain"))
    own = first_dense_block(target_section(F.col("html"), F.col("target")))
    article = F.nullif(F.regexp_extract("html", "(?is)<article.*?</article>", 0), F.lit(""))
    quoted = F.regexp_replace(V.bare(F.col("target")), r"([.+*?^$(){}|\[\]\\])", r"\\$1")
    under = F.regexp_substr("html", F.concat(F.lit(r"(?is)<h([1-6])[^>]*>(?:(?!</h).)*?"), quoted, F.lit(r".*?</h\1>.*?(?=<h[1-6]|\z)")))
    under = F.regexp_replace(under, r"(?is)^<h([1-6])[^>]*>.*?</h\1>", "")
    rows = joined(rows, plain, "page_id", "left")
    content = F.coalesce(own, container_text(F.col("html")), F.col("plain"), F.when(F.col("kind") != "js-render", F.coalesce(densest_block(article), first_dense_block(under), densest_block(T.section_text(F.col("html"))))))
    # a generator keeps the filter from being computed from the page once more for each use
    out = rows.select("page_id", V.canonical(F.coalesce("target", "plain_version", F.lit("0.0.0"))).alias("version"), F.explode(F.array(content)).alias("content"), "kind")
    out = out.where(F.col("content").isNotNull() & ~T.not_a_changelog(F.col("content")))
    confidence = F.when(T.good_changelog(F.col("content")), "high").otherwise("medium")
    return out.select("page_id", "version", "content", T.language(F.col("content")).alias("language"), "kind", confidence.alias("confidence"))


def releases(rows: DataFrame) -> DataFrame:
    """(repo, version, date, title, content): each repository's newest release that is neither draft nor pre-release and has a body."""
    fit = rows.where("not draft and not prerelease and tag_name is not null and trim(body) <> ''")
    newest = Window.partitionBy("repo").orderBy(F.desc("published_at"), F.desc(V.three_key(F.col("tag_name"))), "tag_name")
    one = fit.withColumn("k", F.row_number().over(newest)).where("k = 1")
    return one.select("repo", V.canonical(F.col("tag_name")).alias("version"), F.col("published_at").alias("date"), F.col("name").alias("title"), T.tidy(F.col("body")).alias("content"))


def feed_items(items: DataFrame) -> DataFrame:
    """(feed, version, title, content): the first item that names the feed's target, else the first; content in HTML as Markdown. items: feed, ord, target, title, content."""
    said = F.concat_ws(" ", "title", "content")
    hit = F.coalesce(F.contains(said, V.bare(F.col("target"))), F.lit(False))
    one = items.withColumn("k", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc(hit), "ord"))).where("k = 1 and content <> ''")
    found = F.nullif(F.regexp_extract("title", r"\d+\.\d+(?:\.\d+)?", 0), F.lit(""))
    # only markup goes through Python, and one item of a feed
    marked = F.col("content").rlike(r"</?[a-zA-Z][^>]*>|&[a-z#0-9]+;")
    one = one.withColumn("markdown", H.markdown(F.when(marked, F.col("content"))))
    content = F.when(marked, F.col("markdown")).otherwise(F.col("content"))
    return one.select("feed", V.canonical(F.coalesce("target", found, F.lit("0.0.0"))).alias("version"), "title", T.tidy(content).alias("content"))


def by_source(pages: DataFrame, published: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, attempt, version, content, language, confidence): a changelog for each page that some attempt finds one for.

    pages: page_id, type (of its source, as classified), repo, feed, target, html, linked
    (the HTML of the page that its newest version, or the target, links to) and rendered
    (its HTML as a browser has it), any of them null. published: releases of repositories;
    items: those of feeds, as their readers give them. A repository has its newest
    release, a feed its item. A page has the first of: the target's section of the main
    text as Markdown, its first section with a version, the whole main text, the linked
    page, the page by its markup if good, the block of the rendered page that holds the
    target (the whole page if none does), and the page by its markup at all.
    """
    none = F.lit(None).cast("string")
    out = joined(pages.where("type = 'github-releases'"), releases(published), "repo").select("page_id", F.lit(1).alias("attempt"), "version", "content")
    asked = joined(items.drop("target"), pages.where("type = 'rss'").select("feed", "target").distinct(), "feed")
    found = feed_items(asked).select("feed", "version", "content")
    out = out.unionByName(joined(pages.where("type = 'rss'"), found, "feed").select("page_id", F.lit(2).alias("attempt"), "version", "content"))
    page = written(pages.where("type = 'changelog-page'").select("page_id", "target", "html", "linked", "rendered", H.main_text("html").alias("main")))
    long_ = (F.length("content") > 100) & ~F.col("content").rlike(r"</?[a-z][\s>]")
    for attempt, target in ((3, F.col("target")), (4, none)):
        sections = markdown_sections(page.where("main <> ''").select("page_id", target.alias("target"), "main"), "main")
        out = out.unionByName(sections.where(long_).select("page_id", F.lit(attempt).alias("attempt"), "version", "content"))
    whole = page.select("page_id", F.lit(5).alias("attempt"), V.canonical(F.coalesce("target", F.lit("0.0.0"))).alias("version"), T.tidy(F.col("main")).alias("content"))
    out = out.unionByName(whole.where((F.length("content") > 100) & ~T.not_a_changelog(F.col("content"))))
    named = changelogs(page.where("linked is not null").select("page_id", "target", F.col("linked").alias("html")))
    out = out.unionByName(named.where("length(content) > 20").select("page_id", F.lit(6).alias("attempt"), "version", "content"))
    inline = written(changelogs(page.where("html is not null").select("page_id", "target", "html")))
    out = out.unionByName(inline.where((F.length("content") > 300) & T.good_changelog(F.col("content"))).select("page_id", F.lit(7).alias("attempt"), "version", "content"))
    shown = B.located(page.where("rendered is not null").select("page_id", "target", "rendered"))
    said = F.regexp_extract(F.coalesce("block.title", F.lit("")), r"v?(\d+(?:\.\d+){1,3})", 1)
    shown = shown.select("page_id", F.coalesce("target", F.nullif(said, F.lit(""))).alias("named"), H.main_text(F.coalesce("block.html", "rendered")).alias("content")).where("named rlike '[0-9]'")
    out = out.unionByName(shown.where("length(content) >= 20").select("page_id", F.lit(8).alias("attempt"), V.canonical(F.col("named")).alias("version"), T.tidy(F.col("content")).alias("content")))
    out = out.unionByName(inline.where("length(content) > 150").select("page_id", F.lit(9).alias("attempt"), "version", "content"))
    best = out.groupBy("page_id").agg(F.min_by(F.struct("attempt", "version", "content"), "attempt").alias("x")).select("page_id", "x.attempt", "x.version", "x.content")
    return best.withColumn("language", T.language(F.col("content"))).withColumn("confidence", F.when(F.col("attempt").isin(6, 8), "medium").otherwise("high"))
