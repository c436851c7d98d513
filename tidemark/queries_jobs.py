"""More of the library's queries: labels, discovery, files, with their SQL. Inputs grow with the tables they are made from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as T
from .functions import versions as V
from .operators import changelog, labels
from .plans import fixture
from .plans.tables import folder
from .queries import _CAND, _read, _sql_bare, _sql_matches, query
from .sources import discovery, files, registries

_TEXT = """CASE l_partkey % 8 WHEN 0 THEN 'svg viewBox="0 0 9"' WHEN 1 THEN 'src="app.min.js?v=1"' WHEN 2 THEN 'buildNumber: 7' WHEN 3 THEN 'RudderStack.load' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'release notes' END"""
_SCOPE = "CASE l_suppkey % 5 WHEN 0 THEN 'visible' WHEN 1 THEN 'download-link' ELSE 'noise' END"
_CTX = {"page_id": "l_orderkey", "version": "CASE WHEN l_partkey % 13 = 0 THEN 'v2026.08' WHEN l_partkey % 17 = 0 THEN '2025-03-01' ELSE " + _CAND["version"] + " END", "scope": _SCOPE, "text": _TEXT, "ord": "l_linenumber"}
_CTX_SQL = "(SELECT " + ", ".join(f"{x} AS {k}" for k, x in _CTX.items()) + " FROM lineitem)"
_WANT = {"page_id": "o_orderkey", "expected": "concat(CAST(o_custkey % 4 + 1 AS STRING), '.', CAST(o_orderkey % 6 AS STRING))", "url": "concat('https://shop.example/', CAST(o_custkey AS STRING))"}
_WANT_SQL = "(SELECT " + ", ".join(f"{x} AS {k}" for k, x in _WANT.items()) + " FROM orders)"


def _contexts(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").selectExpr(*[f"{x} AS {k}" for k, x in _CTX.items()])


def _wanted(spark, sf_dir):
    return _read(spark, sf_dir, "orders").selectExpr(*[f"{x} AS {k}" for k, x in _WANT.items()])


def _quoted(text: str) -> str:
    return text.replace("'", "''")


# Labels

_NOISE_SQL = " OR ".join(f"regexp_matches(coalesce(text, ''), '{_quoted(p)}')" for p in labels.STRONG_NOISE)


@query(f"SELECT page_id, version FROM {_CTX_SQL} GROUP BY ALL HAVING bool_and(scope = 'noise') AND bool_or({_NOISE_SQL})")
def strong_noise(spark, sf_dir):
    """Versions that stand in noise of a telling kind only."""
    return labels.strong_noise(_contexts(spark, sf_dir))


@query(
    f"""WITH s AS (SELECT page_id, version FROM {_CTX_SQL} GROUP BY ALL HAVING bool_or(scope <> 'noise'))
    SELECT page_id, version FROM s JOIN {_WANT_SQL} USING (page_id) WHERE NOT {_sql_matches('version', 'expected')}
    AND NOT regexp_matches({_sql_bare('version')}, '^\\d{{4}}([.-]\\d{{1,2}})?$') AND NOT regexp_matches({_sql_bare('version')}, '^\\d{{4}}[.-]\\d{{1,2}}[.-]\\d{{1,2}}')"""
)
def past_versions(spark, sf_dir):
    """Versions of a page that aren't its current one, nor dates."""
    return labels.past_versions(_contexts(spark, sf_dir), _wanted(spark, sf_dir).select("page_id", F.col("expected").alias("current")))


@query(
    f"""SELECT page_id, string_agg(DISTINCT b, '/' ORDER BY b) AS missing FROM (SELECT page_id, {_sql_bare('expected')} AS b FROM {_WANT_SQL}) t
    WHERE NOT EXISTS (SELECT 1 FROM {_CTX_SQL} c WHERE c.page_id = t.page_id AND {_sql_bare('c.version')} = t.b) GROUP BY page_id"""
)
def trusted_not_collected(spark, sf_dir):
    """Pages' trusted versions that no candidate has."""
    return labels.not_collected(_wanted(spark, sf_dir).select("page_id", F.col("expected").alias("version")), _contexts(spark, sf_dir))


@query(f"SELECT page_id, expected FROM {_WANT_SQL} t WHERE NOT EXISTS (SELECT 1 FROM {_CTX_SQL} c WHERE c.page_id = t.page_id AND {_sql_matches('c.version', 't.expected')})")
def uncovered_pages(spark, sf_dir):
    """Pages to render, as no candidate matches what is expected."""
    return labels.uncovered(_wanted(spark, sf_dir).select("page_id", "expected"), _contexts(spark, sf_dir).select("page_id", "version"))


@query(
    f"""WITH c AS (SELECT DISTINCT page_id, version, ord, scope FROM {_CTX_SQL}), s AS (SELECT * FROM c WHERE ord <= 2), r AS (SELECT * FROM c WHERE ord > 2)
    SELECT page_id, version, ord, 'static' AS source FROM s UNION ALL
    SELECT page_id, version, min(ord) AS ord, 'l2-render' FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = r.page_id AND s.version = r.version) GROUP BY page_id, version"""
)
def rendered_union(spark, sf_dir):
    """Static candidates and those that rendering adds."""
    rows = _contexts(spark, sf_dir).select("page_id", "version", "ord", "scope").distinct()
    return labels.with_rendered(rows.where("ord <= 2"), rows.where("ord > 2")).select("page_id", "version", "ord", "source")


@query(
    f"""SELECT label, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, version, 'noise' AS label FROM {_CTX_SQL} WHERE scope = 'noise' UNION ALL SELECT page_id, version, 'positive' FROM {_CTX_SQL} WHERE scope = 'visible'
    UNION ALL SELECT page_id, version, 'link' FROM {_CTX_SQL} WHERE scope = 'download-link') GROUP BY label"""
)
def sample_union(spark, sf_dir):
    """Label buckets as one set of samples."""
    rows = _contexts(spark, sf_dir)
    bucket = lambda scope, label: rows.where(F.col("scope") == scope).select("page_id", "version", F.lit(label).alias("label"))
    return labels.samples(bucket("noise", "noise"), bucket("visible", "positive"), bucket("download-link", "link")).groupBy("label").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"SELECT DISTINCT page_id, expected AS trusted, version FROM {_CTX_SQL} JOIN {_WANT_SQL} USING (page_id) WHERE {_sql_bare('version')} = {_sql_bare('expected')} OR starts_with({_sql_bare('version')}, {_sql_bare('expected')} || '.')")
def trusted_choices(spark, sf_dir):
    """Candidates that are a page's trusted version, or a deeper one of it."""
    return labels.choices(_contexts(spark, sf_dir), _wanted(spark, sf_dir).select("page_id", F.col("expected").alias("trusted")))


@query(
    f"""WITH past AS (SELECT page_id, string_agg(DISTINCT 'v' || {_sql_bare('version')}, ',' ORDER BY 'v' || {_sql_bare('version')}) AS past FROM {_CTX_SQL} WHERE scope = 'visible' GROUP BY page_id)
    SELECT page_id, url, expected, coalesce(past, '') AS past, CASE WHEN page_id % 5 = 0 THEN 'missing-html' END AS reason FROM {_WANT_SQL} LEFT JOIN past USING (page_id) WHERE url NOT LIKE '%7'"""
)
def training_pages(spark, sf_dir):
    """Target pages with their past versions, those without HTML told."""
    wanted = _wanted(spark, sf_dir)
    rows = _contexts(spark, sf_dir).select("page_id", "version", F.when(F.col("scope") == "visible", "historical_product").otherwise("non_product").alias("label"))
    html = wanted.where("page_id % 5 <> 0").select("page_id", F.lit("<p>x</p>").alias("html"))
    return labels.page_list(wanted, rows, html, wanted.where("url like '%7'")).withColumn("past", F.array_join("past", ","))


_TAG_SQL = " , ".join(
    f"CASE WHEN {when} THEN '{labels.TAGS[k]}' END"
    for k, when in {"download": "list_contains(s, 'download-link')", "structured": "list_contains(s, 'structured')", "noise": "list_contains(s, 'noise') AND len(s) = 1", "major": "regexp_matches(b, '^\\d{1,2}$')", "early": "regexp_matches(version, 'rc|beta|alpha|pre')", "large": "regexp_matches(b, '^\\d{4,}$')"}.items()
)


@query(
    f"""WITH v AS (SELECT page_id, version, list_distinct([CASE page_id % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'download-link' ELSE 'structured' END, CASE page_id % 4 WHEN 0 THEN 'noise' ELSE 'structured' END]) AS s, repeat('seen in ' || version || ' ', CASE WHEN page_id % 6 = 0 THEN 60 ELSE 1 END) AS text, regexp_replace(version, '^[vV]+', '') AS b FROM @pages),
    t AS (SELECT page_id, text, array_to_string(list_filter([{_TAG_SQL}], lambda x: x IS NOT NULL), ', ') AS tags FROM v)
    SELECT page_id, CASE WHEN tags <> '' THEN substr(text, 1, 460) || ' [特征: ' || tags || ']' ELSE text END AS text FROM t"""
)
def sample_tags(spark, sf_dir):
    """Samples' texts with the tags of their versions and scopes."""
    scopes = F.array_distinct(F.array(F.when(F.col("page_id") % 3 == 0, "noise").when(F.col("page_id") % 3 == 1, "download-link").otherwise("structured"), F.when(F.col("page_id") % 4 == 0, "noise").otherwise("structured")))
    text = F.repeat(F.concat(F.lit("seen in "), "version", F.lit(" ")), F.when(F.col("page_id") % 6 == 0, 60).otherwise(1))
    return fixture.pages(spark, sf_dir).select("page_id", labels.tagged(text, F.col("version"), scopes).alias("text"))


@query("SELECT p_partkey, regexp_replace(replace(p_name, 'a', '😀𝒳'), '[\\x{10000}-\\x{10FFFF}]', '', 'g') AS plain FROM part")
def basic_plane(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", labels.basic_plane(F.replace("p_name", F.lit("a"), F.lit("😀𝒳"))).alias("plain"))


_NAME_SQL = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Release Notes v1.2' WHEN 1 THEN ' (Desktop) 3' WHEN 2 THEN ' | Updates' ELSE '' END)"


@query(
    f"""WITH t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower({_NAME_SQL}), 'v?\\d+(\\.\\d+)*', ' ', 'g'), '[|–—·():\\[\\]{{}}]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM part),
    w AS (SELECT p_partkey, list_concat([t], list_filter(string_split(t, ' '), lambda w: length(w) >= 3 AND NOT list_contains({labels.GENERIC!r}, w))) AS w FROM t)
    SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND x <> ''), ',') AS terms FROM w"""
)
def product_terms(spark, sf_dir):
    """Products' names and the words that tell them."""
    name = F.expr(_NAME_SQL)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(labels.product_terms(name), ",").alias("terms"))


_RAW = "CASE page_id % 6 WHEN 0 THEN 'deadbeefdeadbeef00' WHEN 1 THEN concat(' ', version, ' ') WHEN 2 THEN 'stable' WHEN 3 THEN concat(version, ' of a very long name indeed') WHEN 4 THEN CAST(NULL AS STRING) ELSE version END"


@query(f"""WITH r AS (SELECT page_id, trim({_RAW}) AS t FROM @pages) SELECT page_id, CASE WHEN regexp_matches(t, '\\d') AND NOT regexp_matches(t, '(?i)^[0-9a-f]{{16,}}$') AND length(t) <= 30 THEN CASE WHEN regexp_matches(t, '^[vV]') THEN t ELSE 'v' || t END END AS value FROM r""")
def live_values(spark, sf_dir):
    """What users' patterns gave, where it may be a version."""
    return fixture.pages(spark, sf_dir).select("page_id", labels.live_value(F.expr(_RAW)).alias("value"))


@query("SELECT scope, CASE WHEN scope IN ('url', 'changelog-url') THEN 'download-link' WHEN scope IN ('structured', 'json-ld', 'changelog-header') THEN 'structured' WHEN scope = 'heading' THEN 'heading' WHEN scope IN ('title', 'body') THEN 'visible' ELSE 'noise' END AS trained, count(*) AS n FROM (SELECT " + _CAND["scope"] + " AS scope FROM lineitem UNION ALL SELECT event_type FROM events) GROUP BY ALL")
def training_scopes(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").selectExpr(f"{_CAND['scope']} AS scope").unionByName(_read(spark, sf_dir, "events").selectExpr("event_type AS scope"))
    return rows.groupBy("scope", labels.training_scope(F.col("scope")).alias("trained")).agg(F.count("*").alias("n"))


_SEQ = "CASE page_id % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN version ELSE concat(version, '.1') END"


@query(f"""WITH r AS (SELECT {_SEQ} AS latest, stored AS expected FROM @pages WHERE stored <> ''), s AS (SELECT count(*) FILTER (latest IS NOT NULL AND {_sql_matches('latest', 'expected')}) AS hit, count(*) FILTER (latest IS NOT NULL AND NOT {_sql_matches('latest', 'expected')}) AS wrong, count(*) FILTER (latest IS NULL) AS missed FROM r)
    SELECT hit, wrong, missed, CAST(hit AS DOUBLE) / (hit + wrong + missed) AS hit_rate, CAST(hit AS DOUBLE) / (hit + wrong) AS precision FROM s""")
def sequence_rates(spark, sf_dir):
    """How often version sequences give what is expected."""
    return labels.sequence_rates(fixture.pages(spark, sf_dir).select(F.expr(_SEQ).alias("latest"), F.col("stored").alias("expected")).where("expected <> ''"))


# Discovery

_HOME = "CASE WHEN p_partkey % 5 = 0 THEN 'https://other.example' WHEN p_partkey % 5 = 1 THEN '' ELSE concat('https://www.', lower(substr(p_brand, 7)), '.example/home') END"
_LIST = {
    "cask": "concat('[', {q}{{\"token\": \"{q}, lower(p_brand), {q}\", \"homepage\": \"{q}, " + _HOME + ", {q}\", \"version\": \"{q}, CASE WHEN p_partkey % 7 = 0 THEN 'latest' ELSE concat(CAST(p_size AS STRING), '.1,55') END, {q}\", \"desc\": \"a cask\"}}, {{\"token\": \"x{q}, CAST(p_partkey AS STRING), {q}\"}}]{q})",
    "formula": "concat({q}[{{\"name\": \"f{q}, CAST(p_partkey AS STRING), {q}\", \"homepage\": \"{q}, " + _HOME + ", {q}\", \"versions\": {{\"stable\": \"{q}, CAST(p_size AS STRING), {q}.0\"}}}}]{q})",
}
_LIST = {k: x.format(q="'") for k, x in _LIST.items()}


@query(
    f"""WITH c AS (SELECT 'cask' AS kind, lower(p_brand) AS token, {_HOME} AS homepage, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'v' || p_size || '.1' END AS version FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT 'cask', 'x' || p_partkey, '', '' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'formula', 'f' || p_partkey, {_HOME}, 'v' || p_size || '.0' FROM part WHERE p_partkey % 2 = 1)
    SELECT kind, token, count(*) AS n FROM (SELECT DISTINCT kind, token FROM c) GROUP BY ALL"""
)
def brew_list(spark, sf_dir):
    """Entries of brew's lists, read from their JSON."""
    part = _read(spark, sf_dir, "part")
    rows = part.where("p_partkey % 2 = 0").selectExpr("'cask' AS kind", f"{_LIST['cask']} AS body").unionByName(part.where("p_partkey % 2 = 1").selectExpr("'formula' AS kind", f"{_LIST['formula']} AS body"))
    return discovery.brew_entries(rows).groupBy("kind", "token").agg(F.count("*").alias("n"))


_BREW = "CASE page_id % 4 WHEN 0 THEN concat('{\"versions\": {\"stable\": \"', version, ',99\"}}') WHEN 1 THEN concat('{\"version\": \"', version, '\"}') WHEN 2 THEN '{\"version\": \"latest\"}' ELSE '{}' END"
_HUB = "CASE page_id % 3 WHEN 0 THEN concat('{\"metadata\": {\"current_release\": {\"version\": \"', version, '\", \"release_date\": \"2026-01-02\"}}}') WHEN 1 THEN '{\"metadata\": {}}' ELSE 'no json' END"
_REL = "CASE page_id % 3 WHEN 0 THEN concat('{\"tag_name\": \"', version, '\", \"body\": \" ', repeat('fix ', CAST(page_id % 20 AS INT)), '\", \"published_at\": \"2026-01-02\"}') WHEN 1 THEN '{\"tag_name\": \"\"}' ELSE '{}' END"


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN version END AS version FROM @pages")
def brew_version(spark, sf_dir):
    """Stable versions in brew's JSON of a formula or cask."""
    return fixture.pages(spark, sf_dir).select("page_id", registries.brew_version(F.expr(_BREW)).alias("version"))


@query("SELECT page_id, CASE WHEN starts_with(version, 'v') THEN version ELSE 'v' || version END AS version, '2026-01-02' AS date FROM @pages WHERE page_id % 3 = 0")
def flathub_release(spark, sf_dir):
    """Current releases in apps' metadata."""
    return fixture.pages(spark, sf_dir).select("page_id", discovery.flathub(F.expr(_HUB)).alias("f")).where("f is not null").select("page_id", "f.version", "f.date")


@query("SELECT page_id, 'v' || regexp_replace(version, '^[vV]', '') AS version, CASE WHEN 4 * (page_id % 20) - 1 > 50 THEN trim(repeat('fix ', CAST(page_id % 20 AS INT))) END AS changelog FROM @pages WHERE page_id % 3 = 0")
def release_notes(spark, sf_dir):
    """Latest releases of repositories, with notes of more than 50 characters."""
    return fixture.pages(spark, sf_dir).select("page_id", discovery.release(F.expr(_REL)).alias("r")).where("r is not null").select("page_id", "r.version", "r.changelog")


_ASK = "CASE WHEN p_partkey % 6 = 0 THEN concat('https://github.com/', lower(p_brand), '/tool') WHEN p_partkey % 6 = 1 THEN concat('https://github.com/', lower(p_brand), '/releases') WHEN p_partkey % 6 = 2 THEN 'no url' ELSE concat('https://', lower(substr(p_brand, 7)), '.example/x') END"
_HIT_SOURCE = "CASE p_partkey % 3 WHEN 0 THEN 'brew' WHEN 1 THEN 'github' ELSE 'npm' END"


def _sql_domain(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract(coalesce({url}, ''), '(?i)https?://([^/:]+)', 1)), '^www\\.', '')"


@query(
    f"""WITH q AS (SELECT p_partkey AS request_id, {_ASK} AS url, {_sql_domain(_ASK)} AS domain FROM part WHERE p_partkey % 11 > 0),
    h AS (SELECT p_partkey - k AS request_id, {_HIT_SOURCE} AS source, lower(replace(p_brand, '#', '')) AS name, 'v' || p_size || '.' || k AS version, {_sql_domain(_HOME)} AS home FROM part, range(0, 2) AS r(k)),
    m AS (SELECT request_id, source, name, CASE WHEN source = 'github' THEN '' ELSE version END AS version, source || ':' || name AS registry_key, home AS matched_domain, false AS from_url FROM q JOIN h USING (request_id) WHERE domain <> '' AND home <> '' AND (home = domain OR ends_with(home, '.' || domain) OR ends_with(domain, '.' || home))),
    o AS (SELECT request_id, regexp_extract(url, '(?i)github\\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1) AS name FROM q WHERE domain <> '')
    SELECT request_id, 'github' AS source, name, '' AS version, 'github:' || name AS registry_key, 'github.com' AS matched_domain, true AS from_url FROM o WHERE name <> '' AND NOT regexp_matches(name, '(?i)/releases?$|\\.git')
    UNION ALL SELECT * FROM m WHERE source <> 'brew' UNION ALL SELECT * FROM (SELECT * FROM m WHERE source = 'brew' QUALIFY row_number() OVER (PARTITION BY request_id, registry_key ORDER BY version DESC, matched_domain) = 1)"""
)
def registry_discovery(spark, sf_dir):
    """Registry candidates of products, from all searches and the URL itself."""
    part = _read(spark, sf_dir, "part")
    requests = part.selectExpr("p_partkey AS request_id", "CASE WHEN p_partkey % 11 > 0 THEN p_name ELSE ' ' END AS product", f"{_ASK} AS url")
    hits = part.selectExpr("*", "explode(array(0, 1)) AS k").selectExpr("p_partkey - k AS request_id", f"{_HIT_SOURCE} AS source", "lower(replace(p_brand, '#', '')) AS name", "concat(CAST(p_size AS STRING), '.', CAST(k AS STRING)) AS version", f"{_HOME} AS homepage")
    return discovery.discovered(requests, hits)


_RSS = "concat('<?xml version=\"1.0\"?><rss xmlns:content=\"http://purl.org/rss/1.0/modules/content/\"><channel><title>feed</title><item><title>Old ', p_brand, '</title><description>first ', CAST(p_size AS STRING), '</description></item><item><title>', p_name, ' 7.', CAST(p_size AS STRING), '</title><content:encoded><![CDATA[<p>second</p>]]></content:encoded><pubDate>today</pubDate></item></channel></rss>')"
_ATOM = "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>f</title><entry><title>', p_brand, '</title><content>only ', CAST(p_size AS STRING), '</content><updated>now</updated></entry></feed>')"


@query(
    """SELECT p_partkey AS feed, 0 AS ord, 'Old ' || p_brand AS title, 'first ' || p_size AS content, NULL AS date FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 1, p_name || ' 7.' || p_size, '<p>second</p>', 'today' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 0, p_brand, 'only ' || p_size, 'now' FROM part WHERE p_partkey % 3 = 1"""
)
def feed_items(spark, sf_dir):
    """Items of RSS and Atom feeds; what is no XML has none."""
    body = F.expr(f"CASE p_partkey % 3 WHEN 0 THEN {_RSS} WHEN 1 THEN {_ATOM} ELSE 'no feed' END")
    return discovery.feed_items(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feed"), body.alias("body")))


@query(
    """SELECT p_partkey AS feed, 'v7.' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '99' END AS version, CASE WHEN p_partkey % 2 = 0 AND NOT contains('Old ' || p_brand || ' first ' || p_size, '7.' || p_size) THEN p_name || ' 7.' || p_size ELSE 'Old ' || p_brand END AS title,
    CASE WHEN p_partkey % 2 = 0 AND NOT contains('Old ' || p_brand || ' first ' || p_size, '7.' || p_size) THEN 'second' ELSE 'first ' || p_size END AS content FROM part"""
)
def feed_choice(spark, sf_dir):
    """Each feed's item of its target, else its first."""
    part = _read(spark, sf_dir, "part")
    target = part.selectExpr("p_partkey AS feed", "concat('7.', CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE '99' END) AS target")
    items = discovery.feed_items(part.select(F.col("p_partkey").alias("feed"), F.expr(_RSS).alias("body")))
    return changelog.feed_items(items.join(target, "feed")).select("feed", "version", "title", "content")


_REQ = "CASE event_id % 6 WHEN 0 THEN 'https://a.example/app.CSS?x' WHEN 1 THEN 'https://www.google-analytics.com/c' WHEN 2 THEN 'https://a.example/data.json' WHEN 3 THEN 'https://a.example/i.webp' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'https://a.example/css/page' END"


@query("SELECT event_id, event_id % 6 IN (0, 1, 3) AS heavy FROM events")
def heavy_requests(spark, sf_dir):
    """Requests that rendering a page does without."""
    return _read(spark, sf_dir, "events").select("event_id", discovery.heavy(F.expr(_REQ)).alias("heavy"))


@query(
    """SELECT page_id, CASE WHEN page_id % 12 = 1 OR page_id % 12 = 5 THEN product END AS product FROM @pages WHERE contains(coalesce(html, ''), 'rel="alternate"')"""
)
def feed_links(spark, sf_dir):
    """Feeds that pages name; the made pages name none."""
    rows = fixture.pages(spark, sf_dir).select("page_id", "product", registries.feed_link(F.coalesce("html", F.lit(""))).alias("feed"))
    return rows.where("feed is not null").select("page_id", "product")


# Files


def _place(spark) -> str:
    return f"{folder(spark)}/files/{uuid.uuid4().hex}"


@query("SELECT page_id, product, url, version, stored FROM @pages")
def json_lines(spark, sf_dir):
    """Pages written as JSONL and read back."""
    rows, path = fixture.pages(spark, sf_dir).select("page_id", "product", "url", "version", "stored"), _place(spark)
    files.write_json_lines(rows, path)
    return files.json_lines(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT event_type AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def json_reports(spark, sf_dir):
    """Reports of one object each, written and read back as JSON files."""
    rows, path = _read(spark, sf_dir, "events"), _place(spark)
    parts = None
    for kind in ("view", "click", "signup", "purchase", "error"):
        own = files.report(rows.where(F.col("event_type") == kind), kind=F.first("event_type"), n=F.count("*"), last=F.max("event_id"))
        parts = own if parts is None else parts.unionByName(own)
    files.write_report(parts, path)
    return files.json_lines(spark, path, "kind string, n long, last long").where("n > 0")


@query(
    """SELECT left(sha1(url), 12) AS id, url, min(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END) AS batch FROM @pages WHERE html IS NOT NULL GROUP BY url"""
)
def page_snapshots(spark, sf_dir):
    """Snapshots of pages, from the first of two batches that has them."""
    rows, paths = fixture.pages(spark, sf_dir), [_place(spark), _place(spark)]
    files.write_snapshots(rows.where("page_id % 3 = 0").dropDuplicates(["url"]).withColumn("html", F.lit("x")).join(rows.where("page_id % 3 = 0 and html is not null").select("url").distinct(), "url", "left_semi"), paths[0])
    files.write_snapshots(rows.where("html is not null").dropDuplicates(["url"]), paths[1])
    return files.snapshots(spark, paths).select("id", "url", "batch")


@query("SELECT '{\"page_id\":' || page_id || ',\"version\":\"' || version || '\",\"stored\":' || CASE WHEN stored IS NULL THEN 'null' ELSE '\"' || stored || '\"' END || '}' AS json FROM @pages")
def api_responses(spark, sf_dir):
    """Answers of the service, of some columns only."""
    return files.response(fixture.pages(spark, sf_dir), "page_id", "version", "stored")


@query()
def changelogs_by_source(spark, sf_dir):
    """A changelog for each page by the kind of its source: releases, feed or page."""
    pages = fixture.pages(spark, sf_dir)
    kind = registries.classified(F.col("url"))
    rows = pages.select("page_id", "html", kind["type"].alias("type"), F.concat_ws("/", kind["owner"], kind["repo"]).alias("repo"), F.col("url").alias("feed"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("linked"), F.col("html").alias("rendered"))
    published = rows.where("type = 'github-releases'").select("repo").distinct().selectExpr("repo", "'v1.2' AS tag_name", "1 AS published_at", "false AS draft", "false AS prerelease", "'one' AS name", "'- a fix' AS body")
    items = rows.where("type = 'rss'").select("feed").distinct().selectExpr("feed", "0 AS ord", "CAST(NULL AS STRING) AS target", "'tool 3.4' AS title", "'what is new' AS content")
    return changelog.by_source(rows, published, items)
