"""The library's queries over the test tables, and the same in SQL where SQL can say it.

Inputs that the tables don't have are made by SQL that both engines read: pages with
versions (plans.fixture), candidates with scores from lineitem, annotations and audit
entries from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as T
from .functions import versions as V
from .operators import arbitration, audit, candidates, changelog, datasets, evaluate, families, features, heuristics, models
from .plans import extract, fixture, tables
from .sources import registries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("@pages", f"({fixture.SQL})").replace("@cands", f"({_CANDS_SQL})").replace("@notes", f"({_NOTES_SQL})")
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CAND = {
    "page_id": "CAST(floor(l_orderkey / 8) AS BIGINT)",
    "version": "concat('v', CAST(l_suppkey % 4 + 1 AS STRING), '.', CAST(l_partkey % 6 AS STRING), CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('.', CAST(l_linenumber AS STRING)) END)",
    "prob": "CAST(l_partkey % 97 AS DOUBLE) / 100",
    "score": "CAST(l_suppkey % 50 AS DOUBLE)",
    "ord": "l_partkey * 1000 + l_orderkey % 8 * 10 + l_linenumber",
    "scope": "CASE l_linenumber WHEN 1 THEN 'title' WHEN 2 THEN 'body' WHEN 3 THEN 'heading' WHEN 4 THEN 'changelog-header' WHEN 5 THEN 'url' ELSE 'structured' END",
    "quantity": "CAST(l_quantity AS BIGINT)",
    "seen": "l_suppkey % 3 > 0",
}
_CANDS_SQL = "SELECT page_id, version, max(prob) AS prob, max(score) AS score, min(ord) AS ord, min(scope) AS scope, CAST(sum(quantity) AS BIGINT) AS points, bool_or(seen) AS seen, bool_or(scope IN ('title', 'structured', 'heading')) AS anchored FROM (SELECT " + ", ".join(f"{x} AS {k}" for k, x in _CAND.items()) + " FROM lineitem) GROUP BY page_id, version"


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").selectExpr(*[f"{x} AS {k}" for k, x in _CAND.items()])
    anchored = F.bool_or(F.col("scope").isin("title", "structured", "heading"))
    return rows.groupBy("page_id", "version").agg(F.max("prob").alias("prob"), F.max("score").alias("score"), F.min("ord").alias("ord"), F.min("scope").alias("scope"), F.sum("quantity").alias("points"), F.bool_or("seen").alias("seen"), anchored.alias("anchored"))


_NOTE = {
    "page_id": "user_id % 300",
    "version": "concat(CAST(event_id % 3 + 1 AS STRING), '.', CAST(event_id % 7 AS STRING))",
    "label": "CASE event_type WHEN 'view' THEN 'historical_product' WHEN 'click' THEN 'non_product' WHEN 'signup' THEN 'ambiguous' WHEN 'purchase' THEN 'current_product' ELSE 'non_product' END",
    "evidence": "event_type",
    "quote": "CASE WHEN event_id % 4 = 0 THEN 'build number' ELSE concat('release ', CAST(event_id % 5 AS STRING)) END",
    "ord": "event_id",
}
_NOTES_SQL = "SELECT " + ", ".join(f"{x} AS {k}" for k, x in _NOTE.items()) + " FROM events"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*[f"{x} AS {k}" for k, x in _NOTE.items()])


# Parts of the SQL that several queries share.
_BARE = "regexp_replace({v}, '^[vV]', '')"


def _sql_bare(v: str) -> str:
    return _BARE.format(v=v)


def _sql_numbers(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '\\d+'), lambda x: coalesce(try_cast(x AS BIGINT), 0))"


def _sql_pad(numbers: str, n: int) -> str:
    return f"list_concat({numbers}, [{', '.join(['0'] * n)}])[1:{n}]"


def _sql_three(v: str) -> str:
    base = f"regexp_replace(regexp_replace({_sql_bare(v)}, '-.*$', ''), '\\+.*$', '')"
    return _sql_pad(f"list_transform(string_split({base}, '.'), lambda x: coalesce(try_cast(regexp_extract(x, '^\\s*(\\d+)', 1) AS BIGINT), 0))", 3)


def _sql_four(v: str) -> str:
    numbers = _sql_numbers(f"regexp_extract({_sql_bare(v)}, '^[^+-]*')")
    return _sql_pad(f"({numbers})[1:4]", 4)


_MARK = "(?i)(^|[.-])(alpha|beta|rc|pre|dev|patch)(\\d*)"


def _sql_before_plus(v: str) -> str:
    return f"regexp_extract({_sql_bare(v)}, '^[^+]*')"


def _sql_evolution(v: str) -> str:
    numbers = _sql_numbers(f"regexp_replace({_sql_before_plus(v)}, '{_MARK}', '', 'g')")
    mark = f"lower(regexp_extract({_sql_before_plus(v)}, '{_MARK}', 2))"
    rank = f"CASE {mark} WHEN 'dev' THEN 1 WHEN 'pre' THEN 2 WHEN 'patch' THEN 2 WHEN 'alpha' THEN 3 WHEN 'beta' THEN 4 WHEN 'rc' THEN 5 ELSE 6 END"
    pre = f"coalesce(try_cast(regexp_extract({_sql_before_plus(v)}, '{_MARK}', 3) AS BIGINT), 0)"
    return f"list_concat({_sql_pad(f'({numbers})[1:4]', 4)}, [{rank}, {pre}])"


def _sql_segments(v: str) -> str:
    return f"len({_sql_numbers(f'''regexp_replace({_sql_before_plus(v)}, '{_MARK}', '', 'g')''')})"


def _sql_text(key: str) -> str:
    return f"array_to_string(list_transform({key}, lambda x: CAST(x AS VARCHAR)), '.')"


def _sql_matches(a: str, b: str) -> str:
    x, y = _sql_bare(a), _sql_bare(b)
    return f"({x} = {y} OR starts_with({x}, {y} || '.') OR starts_with({y}, {x} || '.'))"


def _sql_clean(html: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({html}, '<[^>]+>', ' ', 'g'), '(?i)&(nbsp|amp|lt|gt|quot);', ' ', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g'))"


# Versions


@query(
    f"""SELECT page_id, CASE WHEN regexp_matches(version, '^[vV]') THEN version ELSE 'v' || version END AS normalized,
      'v' || regexp_replace(version, '^[vV]+', '') AS canonical,
      regexp_extract(version, '(?i)v?\\d+(\\.\\d+)?(\\.\\d+)?(\\.\\d+)?([-.]?(alpha|beta|rc|pre|dev|patch)\\d*)?') AS purified, {_sql_bare("version")} AS bare FROM @pages"""
)
def version_normalize(spark, sf_dir):
    v = F.col("version")
    return fixture.pages(spark, sf_dir).select("page_id", V.normalized(v).alias("normalized"), V.canonical(v).alias("canonical"), V.purified(v).alias("purified"), V.bare(v).alias("bare"))


@query(
    f"""SELECT page_id, {_sql_text(_sql_three("version"))} AS three, {_sql_text(_sql_four("version"))} AS four, {_sql_text(_sql_evolution("version"))} AS evolution,
      {_sql_text(_sql_pad(_sql_numbers("regexp_extract(version, '\\d+(\\.\\d+)?(\\.\\d+)?')"), 3))} AS semver,
      {_sql_text(_sql_pad(f"(list_transform(string_split({_sql_bare('version')}, '.'), lambda x: coalesce(CASE WHEN regexp_full_match(x, '\\d+') THEN try_cast(x AS BIGINT) END, 0)))[1:4]", 4))} AS prompt FROM @pages"""
)
def version_keys(spark, sf_dir):
    v = F.col("version")
    keys = {"three": V.three_key, "four": V.four_key, "evolution": V.evolution_key, "semver": V.semver_key, "prompt": V.prompt_key}
    return fixture.pages(spark, sf_dir).select("page_id", *[V.key_text(f(v)).alias(name) for name, f in keys.items()])


@query(
    f"""WITH x AS (SELECT page_id, version, list_transform(string_split({_sql_bare("version")}, '.'), lambda s: coalesce(try_cast(regexp_extract(s, '^\\d+') AS BIGINT), 0)) AS n, {_sql_bare("version")} AS b FROM @pages)
    SELECT page_id, len(list_filter(n, lambda k: k <> 0)) = 0 OR coalesce(n[2], 0) >= 1000 OR coalesce(n[3], 0) >= 10000 OR (len(n) = 1 AND NOT starts_with(version, 'v') AND n[1] >= 100) AS suspicious,
      coalesce(try_cast(regexp_extract(b, '^\\d+') AS BIGINT) BETWEEN 1900 AND 2100, false) AS date_like,
      regexp_full_match(b, '\\d{{4}}([.-]\\d{{1,2}}){{1,2}}') AS yearish, regexp_full_match(regexp_extract(b, '^[^+-]*'), '\\d+(\\.\\d+){{0,3}}') AS clean,
      coalesce(try_cast(regexp_extract(version, '^\\d+') AS BIGINT) BETWEEN 1 AND 99, false) AS sequence_member,
      CASE WHEN len(n) >= 3 THEN 'v?(\\d+\\.\\d+\\.\\d+(?:[-+][0-9A-Za-z.-]+)?)' WHEN len(n) = 2 THEN 'v?(\\d+\\.\\d+)' ELSE 'v?(\\d+)' END AS pattern FROM x"""
)
def version_flags(spark, sf_dir):
    v = F.col("version")
    return fixture.pages(spark, sf_dir).select("page_id", V.suspicious(v).alias("suspicious"), V.date_like(v).alias("date_like"), V.yearish(v).alias("yearish"), V.clean(v).alias("clean"), V.sequence_member(v).alias("sequence_member"), V.suggested_pattern(v).alias("pattern"))


@query(
    f"""SELECT page_id, CASE WHEN stored IS NULL OR stored = '' THEN 'incomparable' WHEN {_sql_three("version")} > {_sql_three("stored")} THEN 'update' WHEN {_sql_three("version")} = {_sql_three("stored")} THEN 'equal' ELSE 'downgrade' END AS verdict,
      {_sql_matches("version", "stored")} AS matches, ({_sql_bare("version")} = {_sql_bare("stored")} OR starts_with({_sql_bare("version")}, {_sql_bare("stored")} || '.')) AS deeper FROM @pages"""
)
def version_cross_check(spark, sf_dir):
    v, s = F.col("version"), F.col("stored")
    return fixture.pages(spark, sf_dir).select("page_id", V.cross_check(v, s).alias("verdict"), V.matches(v, s).alias("matches"), V.matches_prefix(v, s).alias("deeper"))


# Sources


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://(www\.)?github\.com/[^/]+/[^/#?]+/tags') THEN 'github-tags'
        WHEN regexp_matches(url, '(?i)^https?://(www\.)?github\.com/[^/]+/[^/#?]+|^https?://raw\.githubusercontent\.com/[^/]+/[^/]+/|^https?://api\.github\.com/repos/[^/]+/[^/#?]+') THEN 'github-releases'
        WHEN regexp_matches(url, '(?i)\.(xml|rss|atom)(\?|#|$)|/feed(/|$)|/rss(/|$)') THEN 'rss' ELSE 'changelog-page' END AS type,
      nullif(regexp_extract(url, '(?i)^https?://(www\.github\.com|github\.com|raw\.githubusercontent\.com|api\.github\.com/repos)/([^/]+)/([^/#?]+)', 2), '') AS owner,
      nullif(regexp_extract(url, '(?i)^https?://(www\.github\.com|github\.com|raw\.githubusercontent\.com|api\.github\.com/repos)/([^/]+)/([^/#?]+)', 3), '') AS repo FROM @pages"""
)
def source_classify(spark, sf_dir):
    rows = fixture.pages(spark, sf_dir).select("page_id", registries.classified(F.col("url")).alias("s"))
    return rows.select("page_id", "s.type", "s.owner", "s.repo")


@query(
    r"""WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?i)https?://([^/:]+)', 1)), '^www\.', '') AS domain FROM pages)
    SELECT domain, count(*) AS n, min(page_id) AS first_page, bool_or(domain <> '' AND (domain = 'example.com' OR ends_with(domain, '.example.com') OR ends_with('example.com', '.' || domain))) AS ours FROM d GROUP BY domain"""
)
def page_domains(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.bool_or(T.domain_matches(F.col("domain"), F.lit("example.com"))).alias("ours"))


@query(
    r"""SELECT page_id, NOT regexp_matches(url, '(?i)^https?://[^/]') OR regexp_matches(url, '^[^/]+//[^/]*@') OR regexp_matches(lower(url), '^https?://(localhost|0\.0\.0\.0|[^/:?#]*\.local(host)?|(10|127)\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)([/:?#]|$)') AS blocked FROM @pages"""
)
def blocked_hosts(spark, sf_dir):
    return fixture.pages(spark, sf_dir).select("page_id", T.blocked_host(F.col("url")).alias("blocked"))


_KEYS = "CASE p_partkey % 5 WHEN 0 THEN concat('brew:', lower(p_brand)) WHEN 1 THEN concat('winget:', p_brand, '.App') WHEN 2 THEN p_brand WHEN 3 THEN concat('flathub:org.', p_brand) ELSE concat('other:', p_brand) END"


@query(
    f"""WITH k AS (SELECT p_partkey AS page_id, {_KEYS} AS key, p_name FROM part), x AS (SELECT *, lower(string_split(key, ':')[1]) AS kind, contains(key, ':') AND lower(string_split(key, ':')[1]) IN ('winget', 'brew', 'flathub') AS known, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS c FROM k)
    SELECT page_id, CASE WHEN known THEN kind ELSE 'winget' END AS kind, CASE WHEN known THEN regexp_replace(key, '^[^:]*:', '') ELSE key END AS name, c || '.' || c || ',' || c AS ids FROM x"""
)
def registry_dispatch(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_KEYS} AS key", "p_name").withColumn("d", registries.dispatched(F.col("key")))
    return rows.select("page_id", "d.kind", "d.name", F.array_join(registries.winget_ids(F.col("p_name")), ",").alias("ids"))


_FOUND = {
    "request_id": "p_partkey % 150",
    "source": "CASE p_partkey % 3 WHEN 0 THEN 'brew' WHEN 1 THEN 'github' ELSE 'npm' END",
    "name": "concat(p_brand, CAST(p_partkey AS STRING))",
    "version": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('v', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) END",
    "prerelease": "p_partkey % 4 = 0",
    "from_url": "p_partkey % 41 = 0",
}


@query(
    f"""WITH f AS (SELECT {", ".join(f"{x} AS {k}" for k, x in _FOUND.items())} FROM part)
    SELECT request_id, source, name, version FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY prerelease, CASE WHEN from_url THEN -100 WHEN source = 'brew' THEN 0 WHEN source = 'github' THEN 1 ELSE 2 END,
      CASE WHEN regexp_matches(version, '^v?\\d') THEN 0 ELSE 1 END, {_sql_three("version")} DESC, name) = 1"""
)
def registry_pick(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr(*[f"{x} AS {k}" for k, x in _FOUND.items()])
    return registries.best_candidates(rows).select("request_id", "source", "name", "version")


@query(
    f"""WITH e AS (SELECT DISTINCT p_brand || '.' || CAST(p_partkey % 30 AS VARCHAR) AS id, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 11 AS VARCHAR) AS name FROM part UNION ALL SELECT 'x.x', 'notes')
    SELECT id, name AS version FROM e WHERE regexp_matches(name, '^[0-9]') QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_sql_three("name")} DESC, name DESC) = 1"""
)
def registry_listing(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("concat(p_brand, '.', CAST(p_partkey % 30 AS STRING)) AS id", "concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 11 AS STRING)) AS name").distinct()
    return registries.latest_listed(rows.unionByName(spark.sql("SELECT 'x.x' AS id, 'notes' AS name")))


_BODY = "CASE p_partkey % 4 WHEN 0 THEN concat('{\"tag_name\": \"', CAST(p_size AS STRING), '.1\"}') WHEN 1 THEN concat('Download Python 3.', CAST(p_size AS STRING), '.2 now') WHEN 2 THEN concat('JDK 9 and JDK ', CAST(p_size AS STRING)) ELSE 'nothing' END"
_HOST = "CASE p_partkey % 4 WHEN 0 THEN 'https://redis.io/download' WHEN 1 THEN 'https://www.python.org/downloads/' WHEN 2 THEN 'https://jdk.java.net/' ELSE 'https://grafana.com/oss' END"


@query(
    """SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 WHEN 2 THEN 6 END AS rule,
      CASE p_partkey % 4 WHEN 0 THEN 'v' || CAST(p_size AS VARCHAR) || '.1' WHEN 1 THEN 'v3.' || CAST(p_size AS VARCHAR) || '.2' WHEN 2 THEN 'v' || CAST(greatest(9, p_size) AS VARCHAR) END AS version FROM part"""
)
def official_endpoints(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_HOST} AS url", f"{_BODY} AS body")
    found = rows.select("page_id", registries.official(F.col("url"), F.col("body")).alias("o"))
    return found.select("page_id", "o.rule", "o.version")


_RESPONSE = {
    "page_id": "user_id % 100",
    "response_id": "event_id",
    "url": "CASE WHEN event_id % 9 = 0 THEN 'https://www.google-analytics.com/c' ELSE 'https://api.example.com/v' END",
    "content_type": "CASE WHEN event_id % 2 = 0 THEN 'application/json' ELSE 'text/html' END",
    "disposition": "CASE WHEN event_id % 5 = 0 THEN concat('attachment; filename=\"tool-', CAST(event_id % 6 + 1 AS STRING), '.2.zip\"') ELSE CAST(NULL AS STRING) END",
    "body": "concat('{\"version\": \"', CAST(event_id % 4 + 1 AS STRING), '.', CAST(event_id % 3 AS STRING), '\"}')",
}


@query(
    f"""WITH r AS (SELECT {", ".join(f"{x} AS {k}" for k, x in _RESPONSE.items())} FROM events), v AS (
      SELECT page_id, response_id, regexp_extract(body, '"version": "([^"]+)"', 1) AS version FROM r WHERE content_type = 'application/json' AND url NOT LIKE '%google%'
      UNION SELECT page_id, response_id, regexp_extract(disposition, 'tool-([0-9.]+)\\.zip', 1) FROM r WHERE disposition IS NOT NULL AND url NOT LIKE '%google%')
    SELECT page_id, version, count(*) AS n FROM v GROUP BY page_id, version"""
)
def network_versions(spark, sf_dir):
    return registries.network_counts(_read(spark, sf_dir, "events").selectExpr(*[f"{x} AS {k}" for k, x in _RESPONSE.items()]))


@query(
    f"""WITH s AS (SELECT page_id, version, CASE scope WHEN 'title' THEN 'dom' WHEN 'body' THEN 'cta' ELSE 'state' END AS place, points FROM @cands),
    c AS (SELECT page_id, version, points % 4 AS n FROM s), two AS (SELECT * FROM c WHERE n >= 2),
    r AS (SELECT t.page_id, t.version, n, 1 AS rank FROM two t WHERE EXISTS (SELECT 1 FROM s WHERE s.page_id = t.page_id AND s.version = t.version AND place IN ('dom', 'cta'))
      UNION ALL SELECT page_id, version, n, 2 FROM two UNION ALL SELECT page_id, version, 0, 3 FROM s WHERE place = 'cta' UNION ALL SELECT page_id, version, 0, 4 FROM s WHERE place = 'state')
    SELECT page_id, version, ['confirmed', 'frequent', 'button', 'state'][rank] AS why FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, n DESC, {_sql_three("version")} DESC, version) = 1"""
)
def network_adoption(spark, sf_dir):
    rows = _cands(spark, sf_dir)
    place = F.when(F.col("scope") == "title", "dom").when(F.col("scope") == "body", "cta").otherwise("state")
    return registries.adopted(rows.select("page_id", "version", (F.col("points") % 4).alias("n")), rows.select("page_id", "version", place.alias("place")))


# Pages


@query(
    f"""SELECT page_id, {_sql_clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      length({_sql_clean("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<svg\\b.*?</svg>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g'), '(?is)<template\\b.*?</template>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')")}) AS visible_chars,
      len(regexp_extract_all(html, '(?i)(href|src)=["'']((http|/)[^"'']*)["'']')) AS n_links FROM pages"""
)
def page_texts(spark, sf_dir):
    h = F.col("html")
    return _read(spark, sf_dir, "pages").select("page_id", T.title(h).alias("title"), F.length(T.visible_text(h)).cast("long").alias("visible_chars"), F.size(T.links(h)).cast("long").alias("n_links"))


@query(
    r"""SELECT page_id, regexp_replace(html, '(?i)((gpl|lgpl|agpl|mpl|bsd|mit|apache|cc)\s*)?v?\d+(\.\d+){0,2}\s+licen[sc]e\b', ' ', 'g') AS kept,
      CASE WHEN regexp_matches(html, '^\s*[{\[]') THEN 'v' || regexp_extract(html, '"version": "([^"]+)"', 1) END AS json_version,
      nullif(regexp_extract(html, '(?i)Changes?\s+with\s+[^\s<]+\s+v?(\d+(\.\d+){1,3})', 1), '') AS header FROM @pages WHERE html IS NOT NULL"""
)
def page_fields(spark, sf_dir):
    h = F.col("html")
    rows = fixture.pages(spark, sf_dir).where("html is not null")
    return rows.select("page_id", T.without_licences(h).alias("kept"), F.when(T.is_json(h), T.json_version(h)).alias("json_version"), T.header_version(h).alias("header"))


@query(
    r"""WITH u AS (SELECT page_id, unnest(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)(href|src)=["'']([^"'']+)["'']', 2), lambda x: starts_with(x, 'http') OR starts_with(x, '/'))) AS link FROM @pages)
    SELECT page_id, link, regexp_matches(link, '(?i)\.(zip|dmg|exe|msi|tar\.gz|tar\.bz2|tgz|deb|rpm|apk|pkg|7z)(\?|#|$)|/downloads?/|/releases?/|/ftp/|/dl/') AS download FROM u"""
)
def page_links(spark, sf_dir):
    rows = fixture.pages(spark, sf_dir).select("page_id", F.explode(T.links(F.coalesce("html", F.lit("")))).alias("link"))
    return rows.select("page_id", "link", V.download_url(F.col("link")).alias("download"))


@query(
    r"""WITH t AS (SELECT page_id, replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || coalesce(regexp_extract(html, 'content="([^"]*)"', 1), ''), '\s+', ' ', 'g'), ' ', '  ') AS text FROM @pages WHERE coalesce(html, '') <> ''),
    v AS (SELECT page_id, 'semver' AS pattern, unnest(regexp_extract_all(text, '(^|[^0-9.])(v?\d+\.\d+\.\d+)', 2)) AS raw FROM t UNION ALL SELECT page_id, 'minor', unnest(regexp_extract_all(text, '(^|[^0-9.])(v?\d+\.\d+)([^0-9.]|$)', 2)) FROM t)
    SELECT page_id, pattern, 'v' || raw AS version, count(*) AS n FROM v GROUP BY ALL"""
)
def title_candidates(spark, sf_dir):
    rows = candidates.occurrences(fixture.pages(spark, sf_dir)).where("scope = 'title'")
    return rows.groupBy("page_id", "pattern", "version").agg(F.count("*").alias("n"))


@query(
    r"""WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h2>[a-z]+ ([0-9.]+)</h2>', 1)) AS v FROM @pages), k AS (SELECT DISTINCT page_id, v, list_transform(string_split(v, '.'), lambda x: CAST(x AS BIGINT)) AS key FROM v)
    SELECT page_id, 'v' || arg_max(v, key) AS latest, array_to_string(list('v' || v ORDER BY key), ',') AS series FROM k GROUP BY page_id
    HAVING count(DISTINCT key) >= 3 AND (count(DISTINCT key[1]) = 1 OR count(DISTINCT len(key)) = 1) AND count(DISTINCT key) >= 0.3 * (max(key[1]) - min(key[1]) + 1)"""
)
def version_sequences(spark, sf_dir):
    return candidates.sequences(fixture.pages(spark, sf_dir)).select("page_id", "latest", F.array_join("series", ",").alias("series"))


@query(
    r"""SELECT DISTINCT page_id, 'v' || v AS version FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(alphatool|novakit|orbiter|pixelbox)[\s-]*v?(\d+(\.\d+){1,3})', 2)) AS v FROM @pages WHERE html IS NOT NULL) WHERE NOT regexp_full_match(v, '\d{4}([.-]\d{1,2}){1,2}')"""
)
def product_anchors(spark, sf_dir):
    return candidates.product_hits(fixture.pages(spark, sf_dir))


@query()
def heuristic_extract(spark, sf_dir):
    """The rule-based version of every page, with source and confidence."""
    return heuristics.extracted(fixture.pages(spark, sf_dir))


@query()
def context_candidates(spark, sf_dir):
    """Candidates of the context path with their texts."""
    found = candidates.contexts(fixture.pages(spark, sf_dir))
    return found.select("page_id", "version", F.array_join("scopes", ",").alias("scopes"), candidates.sample_text(F.col("version"), F.col("contexts")).alias("text"), candidates.explicit_noise(F.col("contexts")).alias("noise"))


@query()
def labelled_candidates(spark, sf_dir):
    pages = fixture.pages(spark, sf_dir)
    return candidates.labelled(candidates.contexts(pages), pages.select("page_id", "url", F.col("stored").alias("label")))


@query(
    f"""WITH s AS (SELECT page_id, version, points AS score, scope, seen AS in_download, points % 2 = 0 AS in_text, ord, {_sql_three("version")} AS key FROM @cands),
    n AS (SELECT *, count(*) OVER p AS n, max(score) OVER p AS top, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS nth FROM s WINDOW p AS (PARTITION BY page_id)),
    m AS (SELECT *, max(CASE WHEN nth = 2 THEN score END) OVER (PARTITION BY page_id) AS second FROM n),
    r AS (SELECT *, n >= 3 AND top > 0 AND second * 2 >= top AND (in_download OR score * 10 >= top * 7) AS fits, row_number() OVER (PARTITION BY page_id, scope ORDER BY key DESC, ord) AS in_scope FROM m),
    f AS (SELECT page_id, ord FROM r WHERE fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY key DESC, ord) = 1),
    pick AS (SELECT b.page_id, CASE WHEN h.ord IS NOT NULL THEN CASE WHEN h.key > b.key THEN h.ord ELSE b.ord END ELSE CASE WHEN l.key > b.key THEN l.ord ELSE b.ord END END AS ord
      FROM (SELECT * FROM r WHERE nth = 1) b LEFT JOIN (SELECT * FROM r WHERE scope = 'changelog-header' AND in_scope = 1) h USING (page_id) LEFT JOIN (SELECT r.* FROM r JOIN f ON r.page_id = f.page_id AND r.ord = f.ord AND r.fits) l USING (page_id))
    SELECT r.page_id, version, score, scope, CASE WHEN scope IN ('structured', 'body') AND NOT in_download AND NOT in_text THEN 'low' WHEN in_download AND score >= 7 AND in_text THEN 'high' WHEN scope = 'title' AND score >= 7 THEN 'high'
      WHEN scope = 'structured' AND score >= 6 AND in_download THEN 'high' WHEN score >= 5 AND in_text THEN 'medium' ELSE 'low' END AS confidence, n AS n_candidates
    FROM r JOIN pick ON r.page_id = pick.page_id AND r.ord = pick.ord QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY key DESC) = 1"""
)
def heuristic_pick(spark, sf_dir):
    rows = _cands(spark, sf_dir).select("page_id", "version", F.col("points").alias("score"), "scope", F.lit("semver").alias("pattern"), F.col("seen").alias("in_download"), (F.col("points") % 2 == 0).alias("in_text"), "ord")
    return heuristics.picked(rows).select("page_id", "version", "score", "scope", "confidence", "n_candidates")


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY points DESC, ord) AS rank, version, points AS score FROM @cands QUALIFY rank <= 5")
def top_candidates(spark, sf_dir):
    found = heuristics.top_candidates(_cands(spark, sf_dir).select("page_id", "version", F.col("points").alias("score"), "ord"))
    return found.withColumn("rank", F.col("rank").cast("long"))


# Ranking


@query(
    f"""WITH k AS (SELECT page_id, version, {_sql_four("version")} AS key FROM @cands)
    SELECT page_id, version, count(*) OVER p AS page_candidate_count, count(*) OVER m AS same_major_count, rank() OVER (PARTITION BY page_id ORDER BY key DESC) - 1 AS higher_count,
      round((rank() OVER (PARTITION BY page_id ORDER BY key DESC) - 1) / count(*) OVER p, 6) AS rank_pct, key = max(key) OVER p OR {_sql_matches("version", "first_value(version) OVER (PARTITION BY page_id ORDER BY key DESC, version DESC)")} AS is_max,
      len(list_distinct(list(key[1:2]) OVER m)) AS same_major_minor_count FROM k WINDOW p AS (PARTITION BY page_id), m AS (PARTITION BY page_id, key[1])"""
)
def rank_counts(spark, sf_dir):
    rows = features.within_page(_cands(spark, sf_dir))
    return rows.select("page_id", "version", "page_candidate_count", "same_major_count", F.col("higher_count").cast("long").alias("higher_count"), F.round("rank_pct", 6).alias("rank_pct"), (F.col("is_global_max") == 1).alias("is_max"), F.col("same_major_minor_count").cast("long").alias("same_major_minor_count"))


@query(
    f"""SELECT page_id, version, score, round(coalesce(score - lead(score) OVER w, 1.0), 6) AS margin FROM @cands WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, prob DESC, {_sql_four("version")} DESC, version) QUALIFY row_number() OVER w = 1"""
)
def rank_seeds(spark, sf_dir):
    return features.seeds(_cands(spark, sf_dir)).withColumn("margin", F.round("margin", 6))


@query(
    f"""WITH k AS (SELECT *, {_sql_four("version")} AS key FROM @cands) SELECT page_id, arg_max(version, {{'k': key, 'v': version}}) AS greatest, arg_max(version, {{'p': prob, 'k': key, 'v': version}}) AS likeliest FROM k GROUP BY page_id"""
)
def rank_baselines(spark, sf_dir):
    return features.baselines(_cands(spark, sf_dir))


@query()
def rank_features(spark, sf_dir):
    """All rank features of the context candidates."""
    pages = fixture.pages(spark, sf_dir)
    paths = H.element_paths(pages.where("html is not null")).groupBy("page_id", "version").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    found = tables.written(tables.joined(candidates.contexts(pages), paths, ["page_id", "version"], "left"))
    scored = found.select("page_id", "version", (F.lit(0.2) + 0.1 * F.size("scopes")).alias("prob"))
    return features.rank_features(scored, found, pages)


_FAMILY_SQL = f"""WITH RECURSIVE e AS (SELECT *, {_sql_evolution("version")} AS key, {_sql_segments("version")} AS segments FROM @cands WHERE prob > 0.3),
    i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY key, version) AS i, count(*) OVER (PARTITION BY page_id, key[1]) AS members FROM e),
    j AS (SELECT x.page_id, x.i AS a, y.i AS b FROM i x JOIN i y ON x.page_id = y.page_id AND y.i IN (x.i + 1, x.i + 2)
      WHERE CASE WHEN x.key[1] = y.key[1] THEN 1.0 WHEN abs(x.key[1] - y.key[1]) = 1 THEN CASE WHEN x.segments = y.segments THEN 0.85 WHEN abs(x.segments - y.segments) = 1 AND (CASE WHEN x.segments = 2 THEN x.key[2] ELSE y.key[2] END) = 0 THEN 0.72 ELSE 0 END ELSE 0 END * 0.72
        + 0.03 + CASE WHEN x.anchored AND y.anchored THEN 0.08 ELSE 0 END >= 0.58
      AND (x.key[1] = y.key[1] OR ((abs(x.key[1] - y.key[1]) = 1) AND (x.segments = y.segments OR least(x.members, y.members) >= 2)))),
    both_ways AS (SELECT page_id, a, b FROM j UNION ALL SELECT page_id, b, a FROM j),
    reach(page_id, i, root) AS (SELECT page_id, i, i FROM i UNION SELECT r.page_id, w.b, r.root FROM reach r JOIN both_ways w ON w.page_id = r.page_id AND w.a = r.i AND r.root < w.b),
    f AS (SELECT page_id, i, min(root) AS family FROM reach GROUP BY ALL)
    """


def _family_input(spark, sf_dir):
    scopes = F.when(F.col("anchored"), F.array(F.lit("title"))).otherwise(F.array(F.lit("body")))
    return _cands(spark, sf_dir).select("page_id", "version", "prob", "score", scopes.alias("scopes"), F.lit(None).cast("string").alias("path"))


@query(
    _FAMILY_SQL
    + """, s AS (SELECT page_id, family, count(*) AS size, count(DISTINCT key[1:2]) AS bases, avg(prob) AS mean, avg(CASE WHEN anchored THEN 1.0 ELSE 0.0 END) AS share, arg_max({'v': version, 'p': prob}, {'k': key, 'v': version}) AS last FROM i JOIN f USING (page_id, i) GROUP BY page_id, family)
    SELECT page_id, family, size, last.v AS latest, round(ln(1 + size) * 1.5 + least(size / bases, 3.0) * 0.5 + least(1.0, (size + bases) / 12) * 1.8 + mean * 0.45 + share * 0.25 + last.p * 0.35 - CASE WHEN size = 1 THEN 1.5 ELSE 0 END, 6) AS score FROM s"""
)
def version_families(spark, sf_dir):
    stats = families.family_stats(families.families(families.eligible(_family_input(spark, sf_dir))))
    return stats.select("page_id", F.col("family").cast("long").alias("family"), "size", "latest", F.round("score", 6).alias("score"))


_MEMBERS = "(SELECT * FROM i JOIN f USING (page_id, i))"


@query(
    _FAMILY_SQL
    + f""", s AS (SELECT page_id, family, count(*) AS size, count(DISTINCT key[1:2]) AS bases, avg(prob) AS mean, avg(CASE WHEN anchored THEN 1.0 ELSE 0.0 END) AS share, arg_max(prob, {{'k': key, 'v': version}}) AS latest FROM {_MEMBERS} GROUP BY page_id, family),
    named AS (SELECT DISTINCT m.page_id, m.family FROM {_MEMBERS} m JOIN @cands h ON h.page_id = m.page_id AND {_sql_bare("h.version")} = {_sql_bare("m.version")} WHERE h.prob > 0.9),
    t AS (SELECT s.*, least(1.0, (size + bases) / 12) AS trajectory, round(ln(1 + size) * 1.5 + least(size / bases, 3.0) * 0.5 + least(1.0, (size + bases) / 12) * 1.8 + mean * 0.45 + share * 0.25 + latest * 0.35 - CASE WHEN size = 1 THEN 2.7 ELSE 0 END + CASE WHEN n.family IS NULL THEN 0 ELSE 3 END, 9) AS total
      FROM s LEFT JOIN named n USING (page_id, family)),
    near AS (SELECT *, max(total) OVER (PARTITION BY page_id) AS top FROM t),
    best AS (SELECT page_id, family, size FROM near WHERE round(top - total, 9) <= 0.15 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC, trajectory DESC, total DESC, family) = 1),
    own AS (SELECT page_id, version, prob, key, size FROM {_MEMBERS} JOIN best USING (page_id, family)),
    pool AS (SELECT * FROM own UNION SELECT c.page_id, c.version, c.prob, c.key, m.size FROM (SELECT page_id, version, prob, {_sql_evolution("version")} AS key FROM @cands WHERE prob > 0.1) c JOIN (SELECT DISTINCT page_id, key[1] AS major, size FROM own) m ON m.page_id = c.page_id AND m.major = c.key[1])
    SELECT page_id, version, prob, size AS family_size FROM pool QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY key DESC, version DESC, prob DESC, size DESC) = 1"""
)
def family_selection(spark, sf_dir):
    """Each page's version by its best family, product hits counted."""
    rows = tables.written(_family_input(spark, sf_dir))
    return families.selected(rows, rows.where("prob > 0.9").select("page_id", "version"))


@query(
    _FAMILY_SQL
    + f""", s AS (SELECT page_id, family, count(*) AS size, arg_max(version, {{'k': key, 'v': version}}) AS latest FROM {_MEMBERS} GROUP BY page_id, family),
    seed AS (SELECT page_id, version, coalesce(score - lead(score) OVER w, 1.0) AS margin FROM @cands WHERE prob > 0.3 WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, prob DESC, {_sql_four("version")} DESC, version) QUALIFY row_number() OVER w = 1)
    SELECT m.page_id, s.latest AS version, seed.margin, m.anchored OR s.size > 1 AS strong FROM seed JOIN {_MEMBERS} m ON m.page_id = seed.page_id AND m.version = seed.version JOIN s ON s.page_id = m.page_id AND s.family = m.family WHERE s.size > 1 OR m.anchored"""
)
def seed_selection(spark, sf_dir):
    """Each page's version by the family of its best ranked candidate."""
    return families.selected_by_seed(_family_input(spark, sf_dir))


# Changelogs


@query(
    f"""WITH l AS (SELECT page_id, trim(unnest(string_split(html, chr(10)))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS pos FROM @pages WHERE html LIKE 'Changes with%'),
    h AS (SELECT page_id, pos, line, nullif(regexp_extract(line, '^Changes with [^ ]+ ([0-9.]+)$', 1), '') AS v FROM l),
    s AS (SELECT page_id, pos AS start, v, line AS title FROM h WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {_sql_three("v")} DESC, pos) = 1),
    e AS (SELECT h.page_id, min(pos) AS stop FROM h JOIN s USING (page_id) WHERE pos > start AND h.v IS NOT NULL AND line <> title GROUP BY h.page_id)
    SELECT h.page_id, 'v' || s.v AS version, title, string_agg(line, chr(10) ORDER BY pos) AS content FROM h JOIN s USING (page_id) LEFT JOIN e USING (page_id) WHERE pos > start AND (stop IS NULL OR pos < stop) AND line <> '' GROUP BY ALL"""
)
def plain_text_sections(spark, sf_dir):
    rows = fixture.pages(spark, sf_dir).where("html like 'Changes with%'").select("page_id", F.lit(None).cast("string").alias("target"), F.col("html").alias("text"))
    return changelog.plain_sections(rows).select("page_id", "version", "title", "content")


_MD = "concat('# Changes', chr(10), '## 2026-07-', CAST(p_partkey % 18 + 10 AS STRING), ' (', CAST(p_size AS STRING), '.1.2)', chr(10), chr(10), '- first of ', p_name, chr(10), '### Notes', chr(10), 'More.', chr(10), '## ', CAST(p_size AS STRING), '.1.1', chr(10), '- older', chr(10))"


@query(
    """SELECT p_partkey AS page_id, 'v' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.1.2' ELSE '.1.1' END AS version,
      CASE WHEN p_partkey % 2 = 0 THEN '2026-07-' || CAST(p_partkey % 18 + 10 AS VARCHAR) END AS date, CASE WHEN p_partkey % 2 = 0 THEN '- first of ' || p_name || chr(10) || '### Notes' || chr(10) || 'More.' ELSE '- older' END AS content FROM part"""
)
def markdown_sections(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", "CASE WHEN p_partkey % 2 = 1 THEN concat('v', CAST(p_size AS STRING), '.1.1') END AS target", f"{_MD} AS text")
    return changelog.markdown_sections(rows).select("page_id", "version", "date", "content")


@query(
    r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]', '', 'g')) / greatest(length(text), 1) > 0.05 THEN 'zh' ELSE 'en' END AS language,
      length(text) < 20 OR len(regexp_extract_all(text, '\b[0-9A-Fa-f]{32,}\b')) >= 2 AS hashes FROM documents"""
)
def changelog_tests(spark, sf_dir):
    t = F.col("text")
    hashes = F.size(F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,}(?![A-Za-z0-9_])"), 0))
    return _read(spark, sf_dir, "documents").select("doc_id", T.language(t).alias("language"), ((F.length(t) < 20) | (hashes >= 2)).alias("hashes"))


@query(
    r"""SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'none' WHEN regexp_matches(html, '<div id="root"></div>') THEN 'js-render' WHEN regexp_matches(html, '(?i)\bChanges\s+with\s+[A-Za-z0-9_.-]+\s+v?\d+\.\d+') THEN 'plain-text'
      WHEN regexp_matches(html, '(?i)<h[1-4][^>]*>[^<]*v?\d+\.\d+[^<]*</h[1-4]>') THEN 'heading' ELSE 'none' END AS kind FROM @pages"""
)
def changelog_kinds(spark, sf_dir):
    return fixture.pages(spark, sf_dir).select("page_id", T.changelog_kind(F.col("html")).alias("kind"))


@query(
    f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]+href="([^"]+)"', 1)) AS href FROM @pages), v AS (SELECT page_id, href, regexp_extract(href, '(^|[^A-Za-z0-9_])v?(\\d+(\\.\\d+){{1,3}})', 2) AS v FROM a)
    SELECT page_id, href FROM v WHERE v <> '' AND NOT regexp_matches(href, '(?i)\\.(css|js|map|exe|dmg|zip|msi|pkg|7z|tar\\.gz|tar\\.xz|tgz|txz|deb|rpm|apk|dll|iso)(\\?|#|$)|creativecommons|licen[sc]e|privacy|terms|imprint|about|legal') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {_sql_three("v")} DESC) = 1"""
)
def latest_links(spark, sf_dir):
    rows = fixture.pages(spark, sf_dir).select("page_id", T.largest_link(F.coalesce("html", F.lit(""))).alias("l"))
    return rows.where("l is not null").select("page_id", "l.href")


@query()
def changelog_texts(spark, sf_dir):
    """The best changelog text of each page."""
    rows = fixture.pages(spark, sf_dir).select("page_id", "html", F.lit(None).cast("string").alias("target"))
    return changelog.changelogs(rows)


@query(
    f"""WITH r AS (SELECT 'org/' || p_brand AS repo, 'v' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 9 AS VARCHAR) AS tag, p_partkey AS published, p_partkey % 5 = 0 AS draft, p_partkey % 7 = 0 AS pre, p_name FROM part)
    SELECT repo, tag AS version, published AS date, p_name AS content FROM r WHERE NOT draft AND NOT pre QUALIFY row_number() OVER (PARTITION BY repo ORDER BY published DESC) = 1"""
)
def latest_releases(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("concat('org/', p_brand) AS repo", "concat('v', CAST(p_size AS STRING), '.', CAST(p_partkey % 9 AS STRING)) AS tag_name", "p_partkey AS published_at", "p_partkey % 5 = 0 AS draft", "p_partkey % 7 = 0 AS prerelease", "p_name AS name", "p_name AS body")
    return changelog.releases(rows).select("repo", "version", "date", "content")


# Audit

_ENTRY = {
    "seq": "event_id", "url": "concat('https://example.com/', CAST(user_id % 200 AS STRING))", "ts": "ts", "final_version": "concat('v', CAST(event_id % 5 AS STRING), '.', CAST(event_id % 11 AS STRING))",
    "final_confidence": "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END", "llm_triggered": "event_id % 4 = 0", "llm_answer": "CASE WHEN event_id % 8 = 0 THEN concat('v', CAST(event_id % 6 AS STRING), '.', CAST(event_id % 11 AS STRING)) END",
}
_ENTRIES_SQL = "SELECT " + ", ".join(f"{x} AS {k}" for k, x in _ENTRY.items()) + " FROM events"


@query(
    f"""WITH e AS ({_ENTRIES_SQL}), old AS (SELECT * FROM e WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) = 1), new AS (SELECT * FROM e WHERE seq % 2 = 1 AND seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) = 1)
    SELECT left(sha1(url), 24) AS id, url, seq, final_version FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE url NOT IN (SELECT url FROM new))"""
)
def audit_upsert(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").selectExpr(*[f"{x} AS {k}" for k, x in _ENTRY.items()])
    return audit.upserted(audit.latest(rows.where("seq % 2 = 0")), audit.latest(rows.where("seq % 2 = 1 and seq % 3 = 0"))).select("id", "url", "seq", "final_version")


@query(
    f"""WITH l AS (SELECT * FROM ({_ENTRIES_SQL}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) = 1)
    SELECT url, seq, final_version FROM l WHERE llm_triggered AND llm_answer IS NOT NULL AND llm_answer <> final_version AND contains(final_version, '.1') ORDER BY ts DESC, left(sha1(url), 24) LIMIT 20"""
)
def audit_list(spark, sf_dir):
    rows = audit.latest(_read(spark, sf_dir, "events").selectExpr(*[f"{x} AS {k}" for k, x in _ENTRY.items()]))
    cands = rows.select(F.col("id").alias("extraction_id"), F.col("final_version").alias("version"))
    return audit.listed(rows, cands, version="v.1", answer_differs=True, limit=20).select("url", "seq", "final_version")


# Datasets


@query("SELECT page_id, version, label, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence, substr(array_to_string(list_sort(list(DISTINCT quote)), ' | '), 1, 300) AS quotes, count(*) AS dup_count FROM @notes GROUP BY page_id, version, label")
def annotation_dedup(spark, sf_dir):
    return datasets.deduplicated(_notes(spark, sf_dir))


@query(
    """WITH s AS (SELECT page_id, ord, CASE WHEN label = 'ambiguous' AND regexp_matches(quote, '(?i)build|licen[sc]e|sdk|api|minimum|schema|protocol|css|svg') THEN 'non_product' ELSE label END AS label FROM @notes)
    SELECT label, CASE WHEN label = 'current_product' THEN 1 WHEN label IN ('historical_product', 'non_product') THEN 0 END AS binary_label, count(*) AS n FROM s GROUP BY label"""
)
def annotation_labels(spark, sf_dir):
    rows = datasets.settled(_notes(spark, sf_dir))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", datasets.binary_label(F.col("label")).alias("binary_label"), "n")


_DRAW = "CAST(('0x' || left(md5('42:' || {k}), 13))::BIGINT AS DOUBLE) / 4503599627370496.0"


@query(
    f"""WITH x AS (SELECT page_id, version, {_DRAW.format(k="CAST(page_id AS VARCHAR)")} AS x FROM @cands) SELECT page_id, count(*) AS n, CASE WHEN min(x) < 0.7 THEN 'train' WHEN min(x) < 0.85 THEN 'val' ELSE 'test' END AS fold FROM x GROUP BY page_id"""
)
def page_split(spark, sf_dir):
    rows = datasets.split(_cands(spark, sf_dir), "page_id")
    return rows.groupBy("page_id", "fold").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT 'u' || CAST(page_id AS VARCHAR) AS url, version, CASE WHEN points % 10 = 0 THEN 1 ELSE 0 END AS label FROM @cands)
    SELECT url, version, label FROM r QUALIFY label = 1 OR row_number() OVER (PARTITION BY url, label ORDER BY {_DRAW.format(k="url || ' ' || version")}, version) <= greatest(3 * sum(label) OVER (PARTITION BY url), 1)"""
)
def negative_cap(spark, sf_dir):
    rows = _cands(spark, sf_dir).select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), "version", F.when(F.col("points") % 10 == 0, 1).otherwise(0).alias("label"))
    return datasets.capped_negatives(rows)


@query(
    """WITH r AS (SELECT DISTINCT page_id, version, label FROM @notes), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, label ORDER BY version) AS k FROM r)
    SELECT p.page_id, p.version AS pos, n.version AS neg FROM k p JOIN k n ON p.page_id = n.page_id AND p.label = 'current_product' AND (n.label = 'historical_product' OR n.label = 'non_product' AND n.k <= 3)"""
)
def training_pairs(spark, sf_dir):
    return datasets.pairs(_notes(spark, sf_dir).select("page_id", "version", "label").distinct())


@query(
    f"""WITH c AS (SELECT DISTINCT page_id, version FROM @cands WHERE prob > 0.6), s AS (SELECT page_id, version FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.page_id = x.page_id AND starts_with(y.version, x.version || '.')))
    SELECT page_id, CASE WHEN count(DISTINCT ({_sql_four("version")})[1]) = 1 THEN arg_max(version, {{'k': {_sql_four("version")}, 'v': version}}) END AS version FROM s GROUP BY page_id"""
)
def canonical_versions(spark, sf_dir):
    return datasets.canonical_versions(_cands(spark, sf_dir).where("prob > 0.6"))


@query(
    f"""WITH e AS (SELECT page_id, version, sum(CASE scope WHEN 'structured' THEN 10 WHEN 'title' THEN 5 WHEN 'heading' THEN 5 ELSE 0 END) AS evidence FROM (SELECT DISTINCT page_id, version, scope FROM @cands) GROUP BY ALL)
    SELECT page_id, version, CAST(evidence AS BIGINT) AS evidence, CASE WHEN evidence >= 5 THEN 'accept' ELSE 'review' END AS verdict FROM e QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY evidence DESC, {_sql_four("version")} DESC, version) = 1"""
)
def evidence_choice(spark, sf_dir):
    return datasets.evidence_choice(_cands(spark, sf_dir).select("page_id", "version", F.col("scope").alias("kind")))


_CORPUS = {"url": "concat('https://', CAST(p_partkey % 400 AS STRING))", "ord": "p_partkey", "batch": "concat('b', CAST(p_partkey % 3 AS STRING))", "name": "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END", "expected": "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS STRING) END"}


@query(
    f"""WITH c AS (SELECT {", ".join(f"{x} AS {k}" for k, x in _CORPUS.items())} FROM part)
    SELECT url, arg_min(name, ord) FILTER (name <> '') AS name, arg_min(expected, ord) FILTER (expected IS NOT NULL) AS expected, array_to_string(list(batch ORDER BY ord), ',') AS batches FROM c GROUP BY url"""
)
def corpus_merge(spark, sf_dir):
    return datasets.merged(_read(spark, sf_dir, "part").selectExpr(*[f"{x} AS {k}" for k, x in _CORPUS.items()]))


@query(
    """SELECT 'u' || CAST(p_partkey AS VARCHAR) AS url, coalesce(CASE WHEN p_partkey % 10 = 1 THEN 'fixed' END, CAST(p_size AS VARCHAR)) AS expected FROM part WHERE p_partkey % 10 <> 2"""
)
def corpus_corrections(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("concat('u', CAST(p_partkey AS STRING)) AS url", "CAST(p_size AS STRING) AS expected", "p_partkey % 10 AS k")
    return datasets.corrected(rows.select("url", "expected"), rows.where("k = 1").select("url", F.lit("fixed").alias("fixed")), rows.where("k = 2").select("url"))


@query(
    f"""WITH a AS (SELECT page_id, ord, version AS wanted, label FROM @notes), c AS (SELECT DISTINCT page_id, version FROM @cands)
    SELECT c.page_id, c.version, wanted, label FROM c JOIN a ON c.page_id = a.page_id AND {_sql_matches("c.version", "wanted")} QUALIFY row_number() OVER (PARTITION BY c.page_id, c.version ORDER BY ord) = 1"""
)
def annotation_join(spark, sf_dir):
    notes = _notes(spark, sf_dir).select("page_id", "ord", F.col("version").alias("wanted"), "label")
    return datasets.first_annotation(_cands(spark, sf_dir).select("page_id", "version"), notes)


@query(
    f"""WITH r AS (SELECT page_id, version, CASE WHEN version = 'v1.2.1' THEN 2 WHEN {_sql_matches("version", "'1.2.1'")} OR points % 9 = 0 THEN 1 ELSE 0 END AS label FROM @cands)
    SELECT * FROM r QUALIFY max(label) OVER (PARTITION BY page_id) = 2"""
)
def graded_labels(spark, sf_dir):
    label = datasets.graded(F.col("version"), F.lit("1.2.1"), F.col("points") % 9 == 0)
    return datasets.with_target(_cands(spark, sf_dir).select("page_id", "version", label.alias("label")))


# Evaluation


@query(
    f"""WITH r AS (SELECT coalesce({_sql_bare("version")} = {_sql_bare("stored")} OR starts_with({_sql_bare("version")}, {_sql_bare("stored")} || '.'), false) AS ok, page_id % 2 = 0 AS wants, page_id % 3 = 0 AS has FROM @pages)
    SELECT count(*) AS n, CAST(count_if(ok) AS BIGINT) AS passed, CAST(count_if(wants) AS BIGINT) AS n_changelog, CAST(count_if(wants AND has) AS BIGINT) AS passed_changelog, round(count_if(ok) / count(*), 6) AS share FROM r"""
)
def benchmark_accuracy(spark, sf_dir):
    return evaluate.benchmark(fixture.pages(spark, sf_dir).select(F.col("version").alias("actual"), F.col("stored").alias("expected"), (F.col("page_id") % 2 == 0).alias("wants_changelog"), (F.col("page_id") % 3 == 0).alias("has_changelog")))


@query(
    f"""WITH r AS (SELECT version, coalesce({_sql_bare("version")} = {_sql_bare("stored")} OR starts_with({_sql_bare("version")}, {_sql_bare("stored")} || '.'), false) AS ok, coalesce({_sql_three("version")} > {_sql_three("coalesce(stored, '')")}, false) AS newer FROM @pages)
    SELECT count(*) AS n, CAST(count_if(ok) AS BIGINT) AS strict, CAST(count_if(ok OR newer) AS BIGINT) AS honest FROM r"""
)
def strict_honest(spark, sf_dir):
    return evaluate.strict_and_honest(fixture.pages(spark, sf_dir).select(F.col("version").alias("actual"), F.col("stored").alias("expected")))


@query("SELECT prob > 0.5 AS a_ok, score > 25 AS b_ok, count(*) AS n FROM @cands GROUP BY ALL")
def model_crosstab(spark, sf_dir):
    return evaluate.crosstab(_cands(spark, sf_dir).select((F.col("prob") > 0.5).alias("a_ok"), (F.col("score") > 25).alias("b_ok")))


@query(
    """WITH c AS (SELECT CAST(count_if(seen AND prob > 0.5) AS BIGINT) AS tp, CAST(count_if(NOT seen AND prob > 0.5) AS BIGINT) AS fp, CAST(count_if(seen AND prob <= 0.5) AS BIGINT) AS fn, CAST(count_if(NOT seen AND prob <= 0.5) AS BIGINT) AS tn, count(*) AS n FROM @cands)
    SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def classification_scores(spark, sf_dir):
    return evaluate.classification(_cands(spark, sf_dir).select(F.col("seen").cast("int").alias("label"), (F.col("prob") > 0.5).cast("int").alias("predicted")))


@query(
    """WITH k AS (SELECT page_id, points % 6 = 0 AS good, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, version) AS k FROM @cands), p AS (SELECT page_id, min(CASE WHEN good THEN k END) AS first FROM k GROUP BY page_id)
    SELECT count(*) AS pages, CAST(count_if(first = 1) AS BIGINT) AS hits, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM p"""
)
def ranking_scores(spark, sf_dir):
    return evaluate.ranking(_cands(spark, sf_dir).select("page_id", "version", "score", (F.col("points") % 6 == 0).cast("int").alias("label")))


@query(
    """WITH u AS (SELECT page_id, version, CASE WHEN max(prob) OVER p > min(prob) OVER p THEN (prob - min(prob) OVER p) / (max(prob) OVER p - min(prob) OVER p) ELSE 0.5 END AS a, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0.5 END AS b FROM @cands WINDOW p AS (PARTITION BY page_id))
    SELECT page_id, version, round(0.7 * a + 0.3 * b + 0.000001, 4) AS fused FROM u"""
)
def score_fusion(spark, sf_dir):
    return evaluate.fused(_cands(spark, sf_dir)).withColumn("fused", F.round(F.col("fused") + 0.000001, 4))


@query(
    f"""WITH k AS (SELECT page_id, version, prob, {_sql_four("version")} AS key FROM @cands)
    SELECT page_id, coalesce(arg_max(version, {{'k': key, 'v': version}}) FILTER (prob >= 0.5 AND key[1] = 2), arg_max(version, {{'p': prob, 'k': key, 'v': version}})) AS version FROM k GROUP BY page_id"""
)
def chosen_within_major(spark, sf_dir):
    return evaluate.chosen_within_major(_cands(spark, sf_dir).select("page_id", "version", "prob", F.lit("2.0").alias("wanted")))


@query(
    """WITH l AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM l GROUP BY ALL)
    SELECT l.label AS "group", vec_id AS id, round(sum((CAST(x AS DOUBLE) - m) * m), 4) AS dot FROM l JOIN m ON l.label = m.label AND l.pos = m.pos GROUP BY ALL"""
)
def centred_vectors(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return evaluate.centred(rows).withColumn("dot", F.round("dot", 4))


# What only Python or a trained model can say


@query()
def element_paths(spark, sf_dir):
    return H.element_paths(_read(spark, sf_dir, "pages"))


@query()
def html_to_markdown(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", H.markdown("html").alias("markdown"), H.main_text("html").alias("main_text"))


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN nullif(regexp_extract(coalesce(html, ''), 'Version (\d+\.\d+)', 1), '') WHEN page_id % 3 = 1 THEN nullif(regexp_extract(coalesce(html, ''), '\d+\.\d+\.\d+'), '') END AS found FROM @pages")
def user_patterns(spark, sf_dir):
    pattern = F.when(F.col("page_id") % 3 == 0, r"Version (\d+\.\d+)").when(F.col("page_id") % 3 == 1, r"\d+\.\d+\.\d+").otherwise("(unclosed")
    return fixture.pages(spark, sf_dir).select("page_id", H.by_pattern("html", pattern).alias("found"))


@query()
def filter_model(spark, sf_dir):
    """Probabilities of a filter trained on the made candidates."""
    rows = features.version_features(_cands(spark, sf_dir), F.when(F.col("anchored"), F.array(F.lit("heading"))).otherwise(F.array(F.lit("visible")))).withColumn("label", (F.col("points") % 5 == 0).cast("int"))
    model = models.filter_model(rows, features.FILTER_COLUMNS, rounds=5)
    return models.filtered(model, rows).select("page_id", "version", F.round("prob", 6).alias("prob"))


@query()
def extract_pages(spark, sf_dir):
    """The main query: version, source, confidence and changelog of every page."""
    return extract.extract(fixture.pages(spark, sf_dir))


@query()
def arbitration_prompts(spark, sf_dir):
    """What a language model would be asked about close choices."""
    pages = fixture.pages(spark, sf_dir)
    found = candidates.contexts(pages)
    seeds = found.groupBy("page_id").agg(F.min("version").alias("version"), (F.count("*") % 5 / 20).alias("margin"))
    return arbitration.prompts(seeds, found, pages)


@query(
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>'), 1) AS i FROM @pages WHERE html IS NOT NULL),
    t AS (SELECT page_id, i, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '<[^>]+>', ' ', 'g')) AS text FROM a),
    s AS (SELECT *, CASE WHEN regexp_matches(text || ' ' || href, '(?i)download|install|get it|free trial') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(text || ' ' || href, '(?i)windows|mac|linux|ios|android') THEN 1.0 ELSE 0 END + least(length(text) / 20, 1.0) AS score FROM t)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS rank, href, text, round(score, 6) AS score FROM s WHERE score >= 2 QUALIFY rank <= 3""".replace("\\b", "\b")
)
def button_links(spark, sf_dir):
    return arbitration.button_links(fixture.pages(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH p AS (SELECT page_id, html FROM @pages WHERE html LIKE '{%'), k AS (SELECT page_id, html, unnest(json_keys(html)) AS key FROM p)
    SELECT page_id, key, json_extract_string(html, '$.' || key) AS value FROM k WHERE contains(lower(key), 'version') AND length(json_extract_string(html, '$.' || key)) <= 30"""
)
def state_versions(spark, sf_dir):
    rows = fixture.pages(spark, sf_dir).where("html like '{%'").select("page_id", F.col("html").alias("json"))
    return arbitration.state_versions(rows)


@query("SELECT DISTINCT left(sha1(url), 24) AS key, url FROM @pages WHERE url NOT LIKE '%github%'")
def cache_misses(spark, sf_dir):
    """Pages to fetch, as a cache of GitHub's has no fresh copy."""
    pages = fixture.pages(spark, sf_dir).select("url").distinct()
    cache = pages.where("url like '%github%'").select(F.left(F.sha1(F.col("url").cast("binary")), F.lit(24)).alias("key"), F.current_timestamp().alias("ts"))
    return registries.cached(pages, cache, F.current_timestamp())[1].select("key", "url")


@query(
    """SELECT DISTINCT x.p_partkey % 40 AS request_id, lower(y.p_brand) AS token, 'v2.0' AS v FROM part x JOIN part y ON contains(regexp_replace(lower(y.p_brand), '[^a-z0-9]', '', 'g'), regexp_replace(lower(x.p_brand), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(x.p_brand), '[^a-z0-9]', '', 'g'), regexp_replace(lower(y.p_brand), '[^a-z0-9]', '', 'g')) WHERE y.p_brand NOT LIKE '%5'"""
)
def registry_matches(spark, sf_dir):
    """Registry entries by name and domain; those of other domains match none."""
    part = _read(spark, sf_dir, "part")
    requests = part.selectExpr("p_partkey % 40 AS request_id", "p_brand AS product", "'https://www.shop.example/x' AS url").distinct()
    entries = part.selectExpr("lower(p_brand) AS token", "CASE WHEN p_brand LIKE '%5' THEN 'https://other.example' ELSE 'https://shop.example' END AS homepage", "'2.0' AS version").distinct()
    return registries.matched_entries(requests, entries).select("request_id", "token", F.col("version").alias("v")).distinct()


from . import queries_jobs, queries_pages  # noqa: E402, F401  register their own
