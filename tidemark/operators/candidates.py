"""Version candidates of pages: explodes of regular expressions over the parts of a page.

pages: page_id, html (and product, url for some). Null and empty pages give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V

#: Version patterns of the occurrence path. The text around decides: no digit or dot before.
SEMVER = r"(?<![0-9.])v?\d+\.\d+\.\d+(?:-(?:alpha|beta|rc|pre|patch)[0-9.]*)?(?:\+[0-9A-Za-z.-]+)?(?![0-9])"
MINOR = r"(?<![0-9.])v?\d+\.\d+(?![0-9.])"
MAJOR = r"(?<![A-Za-z0-9_])v\d+(?![A-Za-z0-9_])"
PATTERNS = {"semver": SEMVER, "minor": MINOR, "major": MAJOR}
#: Those of the context path: any suffix, but no unit after the number.
LOOSE_SEMVER = r"(?<![0-9.])v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?(?![0-9kKmMbB])"
LOOSE_MINOR = r"(?<![0-9.])v?\d+\.\d+(?![0-9])(?![0-9.\s][kKmMbB])"
NAMED_MAJOR = r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9-]{1,15}\s+v?\d{3}(?![\d.])"
#: Words before a three-digit number that are no product names.
NOT_PRODUCTS = "version ver release releases download downloads build changelog update updates news page chapter step issue issues star stars section date new old latest current stable beta alpha preview archive category article item entry part row col line number no testing test channel canary dev".split()
#: Standards, systems, licences, models and libraries whose numbers aren't the product's.
STANDARDS = (
    "wcag wcga apca aac html css xml xhtml json http https tls ssl usb bluetooth mpeg mp3 mp4 pdf dpi fps lts sdk api oauth openid jwt svg png jpeg gif tiff avif webp "
    "macos mac osx windows win linux ios android iphone ipad watchos tvos directx opengl vulkan sql unicode iso emoji cldr uax sharealike attribution creative cc by sa "
    "gpl lgpl agpl mpl bsd mit license licence licenses licences gpt claude gemini llama mistral o3 o4 devin copilot sonnet opus haiku deepseek qwen grok command falcon phi sparkle fontawesome"
).split()
#: Of those, platforms a product can be made for.
PLATFORMS = "mac osx windows win linux ios android iphone ipad".split()
#: Words that mark scripts, styles and builds.
NOISE = r"(?i)build(?:Number|_number|\s*number)?|minimumOsVersion|minimum_os_version|sdkVersion|sdk_version|apiVersion|api_version|schemaVersion|protocolVersion|viewBox|line-height|font-size|semanticVersion|node_modules|webpack|chunk|\.css|\.js|\.map|svg|asset|bundle|internal version|revision|commit"
#: Scopes by their worth as context.
SCOPES = ["structured", "download-link", "title", "heading", "meta", "visible", "noise"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def occurrences(pages: DataFrame) -> DataFrame:
    """(page_id, ord, version, pattern, scope): every occurrence, in the order of scopes and patterns.

    Scopes: changelog-header, title (with meta), structured, body (after version words),
    heading, url, changelog-url. Suspicious numbers are left out. Occurrences aren't
    made distinct: their number is evidence.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", html.alias("html")).where("html <> ''")
    parts = [
        ("title", F.concat_ws("\n", T.title(F.col("html")), T.meta_text(F.col("html")))),
        ("structured", T.structured_text(F.col("html"))),
        ("body", T.keyword_text(T.body_text(F.col("html")))),
        ("heading", T.headings(F.col("html"))),
    ]
    header = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(?:Changes?\s+with\s+[^\s<]+\s+|Fixed\s+in\s+)v?(\d+(?:\.\d+){1,3})(?=\s|<|$)"), 1)
    urls = T.links(F.col("html"))
    plain = F.filter(urls, lambda u: ~u.rlike(r"(?i)/changelog/|\.(?:js|css|mjs|cjs|map)(?:\?|#|$)"))
    by_url = F.filter(F.transform(plain, lambda u: F.regexp_extract(u, r"(?<![A-Za-z0-9_])v?\d+\.\d+\.\d+(?![A-Za-z0-9_])", 0)), lambda v: v != "")
    by_log = F.filter(F.transform(urls, lambda u: F.regexp_extract(u, r"(?i)/changelog/[^\"'\s>]*[-_/]v(\d+(?:\.\d+){1,3})", 1)), lambda v: v != "")
    single = lambda scope, found: F.struct(F.lit(scope).alias("scope"), F.lit("semver").alias("pattern"), found.alias("found"))
    texts = base.select("page_id", F.posexplode(F.array(*[F.struct(F.lit(scope).alias("scope"), T.without_noise(text).alias("text")) for scope, text in parts])).alias("part", "x")).where("x.text <> ''")
    by_pattern = F.array(*[F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all("x.text", F.lit(regex), 0).alias("found")) for name, regex in PATTERNS.items()])
    in_texts = texts.select("page_id", "part", F.col("x.scope").alias("scope"), F.posexplode(by_pattern).alias("k", "y")).select("page_id", (F.col("part") * 3 + F.col("k") + 1).alias("at"), "scope", "y.pattern", "y.found")
    others = base.select("page_id", F.posexplode(F.array(single("changelog-header", header), single("url", by_url), single("changelog-url", by_log))).alias("k", "x"))
    others = others.select("page_id", F.element_at(F.array(F.lit(0), F.lit(13), F.lit(14)), F.col("k") + 1).alias("at"), "x.scope", "x.pattern", "x.found")
    found = in_texts.unionByName(others).select("page_id", "at", "scope", "pattern", F.posexplode("found").alias("nth", "raw"))
    kept = found.where(~V.suspicious(F.col("raw")))
    return kept.select("page_id", (F.col("at") * 1_000_000 + F.col("nth")).cast("long").alias("ord"), V.normalized(F.col("raw")).alias("version"), "pattern", "scope")


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, latest, series): numbers after one word in navigation and headings that make a series.

    A series has three or more versions after coercion, of one major number or one number
    of segments, and at least 0.3 of them for each major number between first and last. Of
    several series, that with the greatest latest version counts.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    nav = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<nav.*?</nav>"), 0), T.clean_text), " ")
    semantic = pages.select("page_id", F.concat_ws(" ", nav, T.headings(html, "1-6")).alias("text"))
    months = "january february march april may june july august september october november december".split()
    named = r"(?i)(?<![A-Za-z0-9_])([A-Za-z]+[\s-]*?)(?:v|version|ver\.?)?[\s:]*(\d+(?:\.\d+){0,3}(?:[-.]?(?:rc|beta|alpha|pre|patch)\d*)?)(?![A-Za-z0-9_])"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(named), 1).alias("prefix"), F.regexp_extract_all("text", F.lit(named), 2).alias("v"))
    bare = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9.])v?(\d+\.\d+(?:\.\d+)?)(?![A-Za-z0-9.])"), 1), lambda v: F.struct(F.lit("").alias("prefix"), v.alias("v")))
    rows = semantic.select("page_id", F.explode(F.concat(pairs, bare)).alias("x")).select("page_id", F.lower(F.trim("x.prefix")).alias("prefix"), F.col("x.v").alias("v"))
    rows = rows.where((F.length("prefix") <= 20) & ~F.col("prefix").isin(months) & V.sequence_member(F.col("v"))).distinct()
    rows = rows.withColumns({"key": V.semver_key(F.col("v")), "major": F.regexp_extract("v", r"^\d+", 0).cast("long"), "n": F.size(F.split("v", r"\."))})
    groups = rows.groupBy("page_id", "prefix").agg(
        F.count_distinct("key").alias("n_keys"), F.count_distinct("major").alias("n_majors"), F.count_distinct("n").alias("n_sizes"), (F.max("major") - F.min("major")).alias("span"),
        F.max("key").alias("top"), F.max_by("v", F.struct(F.col("key"), -F.col("n"))).alias("latest"), F.array_sort(F.collect_set(F.struct("key", "v"))).alias("series"),
    )
    groups = groups.where("n_keys >= 3 and (n_majors = 1 or n_sizes = 1) and (span = 0 or n_keys / (span + 1) >= 0.3)")
    best = Window.partitionBy("page_id").orderBy(F.desc("top"), "prefix")
    return groups.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("page_id", F.concat(F.lit("v"), "latest").alias("latest"), F.transform("series", lambda x: F.concat(F.lit("v"), x["v"])).alias("series"))


def product_hits(pages: DataFrame) -> DataFrame:
    """(page_id, version): versions right after the product's name; dates left out."""
    pattern = F.concat(F.lit("(?i)"), F.regexp_replace("product", r"([\\.*+?^${}()|\[\]])", r"\\$1"), F.lit(r"[\s-]*v?(\d+(?:\.\d+){1,3})"))
    found = pages.where("product is not null and product <> ''").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), pattern, F.lit(1))).alias("v"))
    return found.where(~V.yearish(F.col("v"))).select("page_id", F.concat(F.lit("v"), "v").alias("version")).distinct()


def _bound(x: Column, f) -> Column:
    """f of x, with x worked out once: a function's own column would be, again for each element that f looks at."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _with_places(text: Column, pattern: str) -> Column:
    """(v, at) of every match: places are sums of the lengths of what lies between."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between"))

    def steps(p: Column) -> Column:
        step = F.transform(p["found"], lambda v, i: F.length(F.get(p["between"], i)) + F.coalesce(F.length(F.get(p["found"], i - 1)), F.lit(0)))
        return F.struct(p["found"].alias("found"), step.alias("steps"))

    def places(p: Column) -> Column:
        return F.transform(p["found"], lambda v, i: F.struct(v.alias("v"), F.aggregate(F.slice(p["steps"], 1, i + 1), F.lit(1), lambda s, x: s + x).alias("at")))

    return _bound(_bound(parts, steps), places)


def contexts(pages: DataFrame) -> DataFrame:
    """(page_id, version, contexts, scopes): each version with the distinct (scope, text) it stands in, at most 8.

    Drawings are reduced to their texts and licences removed first. Numbers after names of
    standards, and dates, are no candidates.
    """
    html = T.without_licences(T.drawings_to_text(F.coalesce(F.col("html"), F.lit(""))))
    base = pages.select("page_id", html.alias("html"))
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)
    download = r"(?i)download|release|\.(?:zip|dmg|exe|msi|pkg|tar\.gz)(?:[?#]|$)"

    def link(a: Column) -> Column:
        href = F.regexp_extract(a, r"""(?i)href=["']([^"']*)["']""", 1)
        return F.struct(F.when(href.rlike(download), "download-link").otherwise("visible").alias("scope"), T.squeezed(F.concat_ws(" ", T.clean_text(a), href)).alias("text"))

    one = lambda scope, text: F.array(F.struct(F.lit(scope).alias("scope"), text.alias("text")))
    fields = F.regexp_extract_all("html", F.lit(rf"""(?i)["'](?:{'|'.join(T.VERSION_FIELDS)})["']\s*:\s*["']([^"']{{1,40}})["']"""), 1)
    blocks = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(script|style|svg)\b.*?</\1>"), 0), lambda b: b.rlike(NOISE))
    near = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(rf"(?is)(?:{NOISE[4:]}).{{0,80}}"), 0)))
    scoped = F.concat(
        one("title", T.title(F.col("html"))), one("meta", T.meta_text(F.col("html"))), one("heading", T.headings(F.col("html"))), one("visible", T.visible_text(F.col("html"))),
        F.transform(anchors, link), F.transform(fields, lambda x: F.struct(F.lit("structured").alias("scope"), x.alias("text"))), F.transform(near, lambda x: F.struct(F.lit("noise").alias("scope"), x.alias("text"))),
    )
    # what has no digit has no version, under any pattern
    parts = base.select("page_id", F.posexplode(scoped).alias("part", "x")).select("page_id", "part", "x.scope", "x.text").where(F.col("text").rlike("[0-9]"))
    plain = r"(?<![0-9.])v?\d+(?:\.\d+){1,3}"
    of = lambda pattern, named: F.transform(_with_places(F.col("text"), pattern), lambda m: F.struct(m["v"].alias("v"), m["at"].alias("at"), F.lit(named).alias("named")))
    found = F.when(F.col("scope") == "noise", of(plain, False)).otherwise(F.concat(of(LOOSE_SEMVER, False), of(LOOSE_MINOR, False), of(NAMED_MAJOR, True)))
    rows = parts.select("page_id", "part", "scope", "text", F.posexplode(found).alias("nth", "m")).select("page_id", "part", "scope", "text", "nth", "m.v", "m.at", "m.named")
    before = F.substr("text", F.greatest(F.col("at") - 30, F.lit(1)), F.least(F.col("at") - 1, F.lit(30)))
    word = F.lower(F.regexp_extract("v", r"^([A-Za-z0-9-]+)", 1))
    rows = rows.where(F.when(F.col("named"), ~word.isin(NOT_PRODUCTS)).when(F.col("scope") == "noise", True).otherwise(~T.standard_before(before, STANDARDS, PLATFORMS)))
    rows = rows.withColumn("v", F.when(F.col("named"), F.regexp_extract("v", r"(\d{3})$", 1)).otherwise(F.col("v")))
    snippet = T.clean_text(F.substr("text", F.greatest(F.col("at") - 90, F.lit(1)), F.lit(180)))
    rows = rows.select("page_id", (F.col("part").cast("long") * 10_000_000 + F.col("nth")).alias("ord"), V.normalized(V.purified(F.col("v"))).alias("version"), "scope", snippet.alias("text"))
    rows = rows.where(~V.iso_date(F.col("version")) & (F.col("text") != ""))
    first = rows.groupBy("page_id", "version", "scope", "text").agg(F.min("ord").alias("ord"))
    grouped = first.groupBy("page_id", "version").agg(F.array_sort(F.collect_list(F.struct("ord", "scope", "text"))).alias("all"))
    kept = F.transform(F.slice("all", 1, 8), lambda x: F.struct(x["scope"].alias("scope"), x["text"].alias("text")))
    return grouped.select("page_id", "version", kept.alias("contexts"), F.array_distinct(F.transform(kept, lambda x: x["scope"])).alias("scopes"))


def chosen_contexts(found: Column) -> Column:
    """The three contexts of most worth, by scope."""
    ranked = F.transform(found, lambda x, i: F.struct(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), x["scope"]).alias("worth"), i.alias("i"), x["scope"].alias("scope"), x["text"].alias("text")))
    return F.transform(F.slice(F.array_sort(ranked), 1, 3), lambda x: F.struct(x["scope"].alias("scope"), x["text"].alias("text")))


def sample_text(version: Column, found: Column) -> Column:
    """The text that a classifier sees: the candidate and its contexts, 480 characters of them."""
    listed = F.array_join(F.transform(chosen_contexts(found), lambda x: F.concat(F.lit("["), x["scope"], F.lit("] "), x["text"])), " | ")
    return F.concat(F.lit("candidate: "), version, F.lit(" [SEP] context: "), F.substring(listed, 1, 480))


def explicit_noise(found: Column) -> Column:
    """Only contexts of noise, and a noise word in one."""
    return F.forall(found, lambda x: x["scope"] == "noise") & F.exists(found, lambda x: x["text"].rlike(NOISE))


def unknown(found: Column, url: Column) -> Column:
    """Neither noise nor sure: the page or a context speaks of versions."""
    endpoint = url.rlike(r"(?i)registry\.npmjs\.org|open-vsx\.org/api|itunes\.apple\.com/lookup|api\.")
    page = url.rlike(r"(?i)changelog|change-log|releases?|history|updates?|version|rss|feed|download|changes|product_history")
    said = F.exists(found, lambda x: x["scope"] != "noise") & F.exists(found, lambda x: x["text"].rlike("(?i)version|release|changelog|download|changes|更新|版本"))
    return ~explicit_noise(found) & (endpoint | page | said)


def labelled(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, version, text, label, reason): 1, 0, or null where unknown.

    pages: page_id, url, label. Pages none of whose candidates is the label's give no rows.
    """
    rows = candidates.join(pages.select("page_id", "url", F.col("label").alias("wanted")), "page_id")
    right, noise = V.matches(F.col("version"), F.col("wanted")), explicit_noise(F.col("contexts"))
    open_ = unknown(F.col("contexts"), F.col("url"))
    rows = rows.withColumn("known", F.max((right & ~noise).cast("int")).over(Window.partitionBy("page_id"))).where("known = 1")
    label = F.when(right, 1).when(noise, 0).when(open_, F.lit(None)).otherwise(0)
    reason = F.when(right, "matches-live-label").when(~noise & open_, "ambiguous-semantic-candidate").otherwise("explicit-noise")
    return rows.select("page_id", "version", sample_text(F.col("version"), F.col("contexts")).alias("text"), label.alias("label"), reason.alias("reason"))
