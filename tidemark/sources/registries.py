"""Where versions come from: kinds of source URLs, registries and official endpoints, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V


def classified(url: Column) -> Column:
    """A struct of type, confidence, owner and repo."""
    u = F.trim(F.coalesce(url, F.lit("")))
    repo = r"(?i)^https?://(?:www\.)?github\.com/([^/]+)/([^/#?]+)(.*)$"
    raw, api = r"(?i)^https?://raw\.githubusercontent\.com/([^/]+)/([^/]+)/", r"(?i)^https?://api\.github\.com/repos/([^/]+)/([^/#?]+)"
    feed = u.rlike(r"(?i)\.(?:xml|rss|atom)(?:\?|#|$)|/feed(?:/|$)|/rss(?:/|$)")
    rest = F.lower(F.regexp_extract(u, repo, 3))
    tags = u.rlike(repo) & rest.contains("/tags") & ~rest.contains("/releases")
    kind = F.when(u == "", "none").when(tags, "github-tags").when(u.rlike(repo) | u.rlike(raw) | u.rlike(api), "github-releases").when(feed, "rss").otherwise("changelog-page")
    part = lambda i: F.nullif(F.when(u.rlike(repo), F.regexp_extract(u, repo, i)).when(u.rlike(raw), F.regexp_extract(u, raw, i)).otherwise(F.regexp_extract(u, api, i)), F.lit(""))
    return F.struct(kind.alias("type"), F.when(kind == "none", "low").when(kind == "changelog-page", "medium").otherwise("high").alias("confidence"), part(1).alias("owner"), part(2).alias("repo"))


def feed_link(html: Column) -> Column:
    """The feed that a page's head names; null if none."""
    head = F.regexp_extract(html, r"(?is)<head[\s>](.*?)</head>", 1)
    return F.nullif(F.regexp_extract(head, r"""(?i)<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*href=["']([^"']+)["']""", 1), F.lit(""))


def dispatched(key: Column) -> Column:
    """A struct of the registry's kind and the key in it; without a known kind it is winget's."""
    kind = F.lower(F.split_part(key, F.lit(":"), F.lit(1)))
    known = key.contains(":") & kind.isin("winget", "brew", "flathub")
    return F.struct(F.when(known, kind).otherwise("winget").alias("kind"), F.when(known, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key).alias("name"))


def winget_ids(name: Column) -> Column:
    """Ids that a product may have there, likeliest first."""
    clean = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    base = F.regexp_replace(F.regexp_replace(clean, "studio$", ""), "desktop$", "")
    twice = lambda c: F.concat(c, F.lit("."), c)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(twice(clean), F.when(base != "", twice(base)), clean))))


def winget_path(package: Column) -> Column:
    """Directory of a package's manifests."""
    return F.concat_ws("/", F.lit("manifests"), F.lower(F.substring(package, 1, 1)), F.replace(package, F.lit("."), F.lit("/")))


def latest_listed(listing: DataFrame) -> DataFrame:
    """(id, version): the greatest of the listed names that begin with a digit."""
    rows = listing.where(F.col("name").rlike("^[0-9]"))
    return rows.groupBy("id").agg(F.max_by("name", F.struct(V.three_key(F.col("name")), "name")).alias("version"))


def brew_version(body: Column) -> Column:
    """The stable version in a formula's or cask's JSON, up to a comma; null if empty or latest."""
    raw = F.coalesce(F.get_json_object(body, "$.versions.stable"), F.get_json_object(body, "$.version"))
    v = F.substring_index(raw, ",", 1)
    return F.when((v != "") & (v != "latest"), v)


def matched_entries(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (token, homepage, version) for requests (request_id, product, url) by name and domain.

    Names match if equal, or if one of four letters or more is part of the other; domains
    if equal or one below the other. Both are joined on the registrable part of the
    domain first, which equal and lower domains share.
    """
    part = lambda d: F.array_join(F.slice(F.split(d, r"\."), F.greatest(F.size(F.split(d, r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    left = requests.select("request_id", plain(F.col("product")).alias("key"), T.domain(F.col("url")).alias("domain")).where("key <> ''").withColumn("site", part(F.col("domain")))
    right = entries.select("token", "homepage", "version", plain(F.col("token")).alias("tok"), T.domain(F.col("homepage")).alias("home")).withColumn("site", part(F.col("home")))
    named = (F.col("tok") == F.col("key")) | ((F.length("tok") >= 4) & (F.contains("tok", F.col("key")) | F.contains("key", F.col("tok"))))
    rows = left.join(right, "site").where(named & T.domain_matches(F.col("domain"), F.col("home")))
    return rows.select("request_id", "token", F.when(F.col("version") != "", V.canonical(F.col("version"))).otherwise("").alias("version"), F.col("home").alias("matched_domain"), F.col("token").rlike(r"(?i)@(?:beta|nightly|snapshot|alpha|dev|rc)(?![A-Za-z0-9_])").alias("prerelease"))


def best_candidates(found: DataFrame) -> DataFrame:
    """One of found (request_id, source, name, version, prerelease, from_url) for each request.

    Stable ones before pre-releases; what the URL names first, then brew, github, npm;
    then the greatest version, those without one last.
    """
    source = F.when(F.col("from_url"), -100).when(F.col("source") == "brew", 0).when(F.col("source") == "github", 1).otherwise(2)
    has = V.bare(F.col("version")).rlike(r"^\d")
    order = Window.partitionBy("request_id").orderBy(F.col("prerelease"), source, F.desc(has), F.desc(V.three_key(F.col("version"))), "name")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


#: Hosts with an endpoint of their own, in order, and how its body gives the version.
ENDPOINTS = [
    (r"itunes\.apple\.com/lookup|apps\.apple\.com", "json", "$.results[0].version", "$.results[0].releaseNotes"),
    (r"registry\.npmjs\.org", "json", "$['dist-tags'].latest", "$.readme"),
    (r"go\.dev|golang\.org", "json", "$[0].version", None),
    (r"python\.org", "text", r"(?i)Download Python\s+(\d+\.\d+\.\d+)", None),
    (r"postgresql\.org", "current", "", None),
    (r"blackmagicdesign\.com", "text", r"(?i)DaVinci Resolve\s+(\d{1,2})", None),
    (r"jdk\.java\.net", "max", r"(?i)JDK\s+(\d{1,2})", None),
    (r"filezilla-project\.org", "text", r"(?i)Download FileZilla Client\s+(\d+\.\d+\.\d+)", None),
    (r"grafana\.com", "text", r"(?i)Version\s+(\d+\.\d+\.\d+)", None),
    (r"redis\.io", "json", "$.tag_name", None),
]


def official(url: Column, body: Column) -> Column:
    """A struct of rule, version and changelog of the first endpoint whose host is in the URL; null if its body has none."""
    out = F.lit(None).cast("struct<rule:int,version:string,changelog:string>")
    for i, (host, how, what, notes) in reversed(list(enumerate(ENDPOINTS))):
        if how == "json":
            v = F.regexp_replace(F.get_json_object(body, what), "^go", "")
        elif how == "text":
            v = F.nullif(F.regexp_extract(body, what, 1), F.lit(""))
        elif how == "max":
            v = F.array_max(F.regexp_extract_all(body, F.lit(what), 1).cast("array<int>")).cast("string")
        else:
            v = F.get(F.filter(F.from_json(body, "array<struct<major:string,current:boolean>>"), lambda x: x["current"]), F.lit(0))["major"]
        text = F.trim(F.get_json_object(body, notes)) if notes else F.lit(None).cast("string")
        text = F.when(F.length(text) > (50 if "readme" in (notes or "") else 0), text)
        out = F.when(url.rlike(host) & v.isNotNull(), F.struct(F.lit(i).alias("rule"), V.canonical(v).alias("version"), text.alias("changelog"))).otherwise(out)
    return out


def network_counts(responses: DataFrame) -> DataFrame:
    """(page_id, version, n): in how many of a page's responses each version is, from JSON bodies and file names.

    responses: page_id, response_id, url, content_type, disposition, body. Bodies of 2 MB
    and more, and those of trackers, are not read.
    """
    own = responses.where(~F.col("url").rlike(r"(?i)google-analytics|googletagmanager|doubleclick|facebook|hotjar|segment\.|sentry|intercom"))
    body = F.when(F.col("content_type").contains("json") & (F.length("body") < 2_000_000), T.json_versions(F.col("body"))).otherwise(F.array().cast("array<string>"))
    name = F.regexp_extract(F.coalesce("disposition", F.lit("")), r"""(?i)filename\*?=["']?([^"';]+)""", 1)
    rows = own.select("page_id", "response_id", F.explode(F.array_distinct(F.concat(body, T.filename_versions(name)))).alias("version")).distinct()
    return rows.groupBy("page_id", "version").agg(F.count("*").alias("n"))


def adopted(counts: DataFrame, shown: DataFrame) -> DataFrame:
    """(page_id, version, why): confirmed by two responses and the page or its buttons, else by two responses, else by a button, else by page state.

    counts: network_counts; shown: page_id, version, place (dom, cta or state).
    """
    two = counts.where(F.col("n") >= 2).select("page_id", "version", "n")
    backed = two.join(shown.where("place in ('dom', 'cta')").select("page_id", "version").distinct(), ["page_id", "version"], "left_semi").withColumn("rank", F.lit(1))
    rows = backed.unionByName(two.withColumn("rank", F.lit(2)))
    for place, rank in (("cta", 3), ("state", 4)):
        rows = rows.unionByName(shown.where(F.col("place") == place).select("page_id", "version", F.lit(0).cast("long").alias("n"), F.lit(rank).alias("rank")))
    rows = rows.where(V.bare(F.col("version")).rlike(r"^\d+\.\d+"))
    order = Window.partitionBy("page_id").orderBy("rank", F.desc("n"), F.desc(V.three_key(F.col("version"))), "version")
    one = rows.withColumn("k", F.row_number().over(order)).where("k = 1")
    why = F.element_at(F.array(*[F.lit(x) for x in ("confirmed", "frequent", "button", "state")]), F.col("rank"))
    return one.select("page_id", V.canonical(F.col("version")).alias("version"), why.alias("why"))


def cached(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (url) in a cache (key, ts, body) of the last hours, by the first 24 digits of the URL's SHA-1."""
    keyed = requests.withColumn("key", F.left(F.sha1(F.col("url").cast("binary")), F.lit(24)))
    fresh = cache.where(F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return keyed.join(fresh, "key"), keyed.join(fresh, "key", "left_anti")
