"""The queries of this subpackage: name to function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents at similarity 0.85 of 5-word shingles."""
    from .neardup import classes

    found = classes(read(spark, sf_dir, "documents"), similarity=0.85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL["op3_minhash_neardup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM words, range(1, CASE WHEN len(w) = 0 THEN 1 WHEN len(w) < 5 THEN 2 ELSE len(w) - 2 - 1 END) AS r(i)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * pairs.n >= 85 * (p.n + q.n - pairs.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""


@query
def op7_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows of 13 words."""
    from .decontam import judged

    found = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL["op7_wu_manber_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), test AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM item, range(1, len(w) - least(13, len(w)) + 2) AS r(i) WHERE len(w) > 0
), place AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM doc, (SELECT DISTINCT size FROM test), range(1, len(w) - size + 2) AS r(i) WHERE len(w) >= size
), found AS (SELECT doc_id, place.size, i, item_id FROM place JOIN test ON place.size = test.size AND place.s = test.s),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT doc_id, size, i FROM found), range(0, size) AS r(k) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels.toxic."""
    from ._cluster import crc32_of
    from .toxicity import scored

    found = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(crc32_of(F.col("doc.doc_id")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence rules."""
    from .quality import judged

    return judged(read(spark, sf_dir, "documents"))


def _is(kind: str) -> Callable:
    return lambda x: F.when(x["kind"] == kind, 1)


@query
def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    from .pii import KINDS, joined, spans

    found = spans(read(spark, sf_dir, "documents"))
    counts = [F.size(F.array_compact(F.transform("base", _is(k)))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc.doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated spans."""
    from .sentences import deduplicated

    return deduplicated(read(spark, sf_dir, "documents")).select("doc.doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("changed"), "text")


@query
def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as read back from their archives, in order of capture."""
    from .warc import round_trip

    found = round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLE_SQL["op9_warc_index_merge"] = r"""
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, payload, hex, list_transform(range(0, 32), lambda i: CAST(
    (('0x' || substr(hex || '0', 1 + (i * 5) // 4, 3))::INTEGER >> (12 - 5 - (i * 5) % 4)) & 31 AS INTEGER)) AS fives FROM page
), kept AS (SELECT hex, max(page_id) AS kept FROM page GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM bits JOIN kept USING (hex)
"""


@query
def op2_template_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings in its texts, formatted and read back."""
    from .chat import digests, formatted

    odd = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return digests(formatted(rows.unionByName(more)))


ORACLE_SQL["op2_template_compiler"] = r"""
WITH row_of AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS r, replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>') AS t FROM row_of
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ') + length(r) + 2 + length(t) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op4_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    from .packing import packed

    return packed(read(spark, sf_dir, "documents"))


@query
def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz scores of all documents, learned from those with remainders other than 2."""
    from ._cluster import crc32_of
    from .katz import scores

    held_out = F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
    found = scores(read(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) of which a tenth, by the id's crc32, repeat a stretch of their words up to the end."""
    from ._cluster import crc32_of

    h = F.coalesce(crc32_of(F.col("doc_id")), F.lit(1))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8))))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    tailed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    own = docs.select("doc_id", "text", h.alias("h"))
    own = own.withColumn("words", F.when((F.col("h") % 10 == 0), words)).withColumn("words", F.when(F.size("words") > 0, F.col("words")))
    return own.withColumn("a", a).withColumn("p", p).select("doc_id", F.when(F.col("words").isNotNull(), tailed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of all documents, a tenth of which repeat a stretch of their words."""
    from .periods import repeated_runs

    found = repeated_runs(_with_tails(read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    plain = F.array_join(F.filter(F.split(F.coalesce("doc.text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    found = found.select("*", longest.alias("longest"))
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", plain).cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that are similar to 0.8 by their 5-word shingles."""
    from .groups import joined

    return joined(read(spark, sf_dir, "documents"))


ORACLE_SQL["op12_token_groups"] = ORACLE_SQL["op3_minhash_neardup"].replace("85 *", "80 *").replace(", d.doc_id = component_id AS kept", "")


@query
def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in 40 clusters after five rounds of exact k-means."""
    from .elkan import clustered, quantised

    vectors = quantised(read(spark, sf_dir, "embeddings"), 64)
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = clustered(vectors, 40, 5, order, 64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


def _elkan_sql(k: int, rounds: int, dims: int) -> str:
    """One assignment after the other, of all vectors to all centroids."""
    between = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(least(greatest(256 * CAST(e AS DOUBLE), -134217728), 134217728)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})
)"""
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS (SELECT r, j, {between} AS d FROM v, c{t}), a{t} AS MATERIALIZED (SELECT r, j, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT j, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{t} JOIN v USING (r), range(1, {dims + 1}) AS q(i) GROUP BY j, i),
c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (SELECT j, list(m ORDER BY i) AS c FROM s{t} GROUP BY j) m USING (j))""")
    return f"""
WITH {", ".join(steps)}, per AS (SELECT j, sum(d) AS own FROM a{rounds} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(own) FROM per) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} USING (j) JOIN per USING (j)
"""


ORACLE_SQL["op13_elkan_clusters"] = _elkan_sql(40, 5, 64)
