"""Finding a product's registry entry: lists and searches by the home page's domain, feeds, blocked requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V

_ENTRY = "array<struct<token:string,name:string,homepage:string,version:string,versions:struct<stable:string>,desc:string>>"
_ITEM = "struct<title:string,description:string,encoded:string,content:string,summary:string,pubDate:string,updated:string,published:string>"
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>"
# What a page's rendering needn't load.
HEAVY = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp4|webm|mp3|ogg|mov|css)(\?|#|$)"
TRACKERS = (
    "(?i)(googletagmanager|google-analytics|gtag|doubleclick|facebook\\.net|connect\\.facebook|mc\\.yandex|hotjar|clarity\\.ms|mixpanel|segment\\.io|sentry|"
    "bugsnag|posthog|fullstory|intercom|zendesk|tawk|crisp|adsystem|adservice)"
)


def _v(version: Column) -> Column:
    """A version with a v in front; empty for none and for latest."""
    bare = F.trim(F.substring_index(F.coalesce(version, F.lit("")), ",", 1))
    return F.when((bare == "") | (bare == "latest"), "").when(F.startswith(bare, F.lit("v")), bare).otherwise(F.concat(F.lit("v"), bare))


def brew_entries(lists: DataFrame) -> DataFrame:
    """(kind, token, homepage, version, description) of the entries of brew's lists (kind, body): casks, then formulae that aren't casks too."""
    rows = lists.select("kind", F.explode(F.from_json("body", _ENTRY)).alias("e"))
    rows = rows.select("kind", F.coalesce("e.token", "e.name").alias("token"), F.coalesce("e.homepage", F.lit("")).alias("homepage"), _v(F.coalesce("e.versions.stable", "e.version")).alias("version"), F.coalesce("e.desc", F.lit("")).alias("description"))
    order = Window.partitionBy("token").orderBy((F.col("kind") != "cask").cast("int"), "kind")
    return rows.where("token <> ''").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def flathub(body: Column) -> Column:
    """A struct of version and date: the current release in an app's metadata; null if none."""
    at = "$.metadata.current_release."
    version = F.nullif(F.get_json_object(body, at + "version"), F.lit(""))
    return F.when(version.isNotNull(), F.struct(_v(version).alias("version"), F.get_json_object(body, at + "release_date").alias("date")))


def release(body: Column) -> Column:
    """A struct of version, changelog and date of a repository's latest release; notes of 50 characters or fewer are none."""
    notes = F.trim(F.get_json_object(body, "$.body"))
    tag = F.nullif(F.get_json_object(body, "$.tag_name"), F.lit(""))
    version = F.concat(F.lit("v"), F.regexp_replace(tag, "^[vV]", ""))
    return F.when(tag.isNotNull(), F.struct(version.alias("version"), F.when(F.length(notes) > 50, notes).alias("changelog"), F.get_json_object(body, "$.published_at").alias("date")))


def url_repository(url: Column) -> Column:
    """owner/name of the repository that a URL is in; null if it is none, or a release of one."""
    found = F.regexp_extract(url, r"(?i)github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1)
    return F.when((found != "") & ~found.rlike(r"(?i)/releases?$|\.git"), found)


def discovered(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(request_id, source, name, version, registry_key, matched_domain, from_url): candidates of each request.

    requests: request_id, product, url; hits: request_id, source (brew, github or npm),
    name, version, homepage, as the searches gave them. Kept are those whose home page is
    of the request's domain, of brew's one for each name, and the repository that the URL
    itself is in. Requests without a name or a domain have none; a search that gave no
    rows, or failed, takes nothing from the others.
    """
    asked = requests.select("request_id", "url", T.domain(F.col("url")).alias("domain")).where("domain <> '' and trim(product) <> ''")
    rows = hits.join(asked, "request_id").withColumn("home", T.domain(F.col("homepage"))).where(T.domain_matches(F.col("home"), F.col("domain")))
    rows = rows.select("request_id", "source", "name", F.when(F.col("source") == "github", "").otherwise(_v(F.col("version"))).alias("version"), F.concat_ws(":", "source", "name").alias("registry_key"), F.col("home").alias("matched_domain"), F.lit(False).alias("from_url"))
    order = Window.partitionBy("request_id", "registry_key").orderBy(F.desc("version"), "matched_domain")
    rows = rows.withColumn("k", F.when(F.col("source") == "brew", F.row_number().over(order)).otherwise(1)).where("k = 1").drop("k")
    name = url_repository(F.col("url"))
    own = asked.where(name.isNotNull()).select("request_id", F.lit("github").alias("source"), name.alias("name"), F.lit("").alias("version"), F.concat(F.lit("github:"), name).alias("registry_key"), F.lit("github.com").alias("matched_domain"), F.lit(True).alias("from_url"))
    return own.unionByName(rows)


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed, ord, title, content, date) of the items of RSS and Atom feeds (feed, body); what isn't XML has none."""
    root = F.from_xml(F.col("body"), _FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = feeds.select("feed", root.alias("r")).select("feed", F.posexplode(F.coalesce("r.channel.item", "r.item", "r.entry")).alias("ord", "i"))
    return rows.select("feed", "ord", F.col("i.title").alias("title"), F.coalesce("i.encoded", "i.content", "i.description", "i.summary", F.lit("")).alias("content"), F.coalesce("i.pubDate", "i.published", "i.updated").alias("date"))


def heavy(url: Column) -> Column:
    """Whether rendering a page does without this request: media, styles, trackers."""
    return F.coalesce(url.rlike(HEAVY) | url.rlike(TRACKERS), F.lit(False))
