"""Queries of the operators on whole pages: mentions, the trained ranker, batched inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import evaluate, inference, mentions, ranker
from .operators.features import RANK_COLUMNS
from .plans import extract, fixture, training
from .queries import _cands, _read, query

_VERSION = r"\d+\.\d+(?:\.\d+)?"


@query(
    r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM @pages),
    c AS (SELECT DISTINCT page_id, html, unnest(regexp_extract_all(html, '\d+\.\d+(?:\.\d+)?')) AS bare FROM p),
    r AS (SELECT page_id, run, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '[0-9.]+')) AS run FROM p) GROUP BY ALL),
    a AS (SELECT c.*, strpos(html, bare) AS place FROM c)
    SELECT a.page_id, 'v' || bare AS version, CAST((length(html) - length(replace(html, bare, ''))) // length(bare) AS INTEGER) AS times, CAST(coalesce(r.n, 0) AS INTEGER) AS bounded, CAST(place - 1 AS INTEGER) AS first,
      nullif(lower(regexp_extract(substr(html, greatest(place - 80, 1), place - greatest(place - 80, 1)), '(?i)<(/?[a-z0-9]+)\b[^>]*>[^<]*$', 1)), '') AS tag
    FROM a LEFT JOIN r ON r.page_id = a.page_id AND r.run = a.bare"""
)
def version_mentions(spark, sf_dir):
    """How often, where and after which tag each version stands in its page."""
    pages = fixture.pages(spark, sf_dir).select("page_id", "html")
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_VERSION), F.lit(0)))).alias("v")).select("page_id", F.concat(F.lit("v"), "v").alias("version"))
    return mentions.mentions(pages, found).select("page_id", "version", "times", "bounded", "first", "tag")


@query()
def page_ranker(spark, sf_dir):
    """Scores of a ranker trained on the made pages, best first in each page."""
    rows = training.ranking_rows(fixture.pages(spark, sf_dir), F.col("stored"))
    model = ranker.trained(rows, RANK_COLUMNS)
    return ranker.ranked(model, rows).select("page_id", "version", "fold", "label", F.round("score", 9).alias("score"))


@query()
def extract_ranked(spark, sf_dir):
    """The main query with a ranker that pages of known versions have taught."""
    pages = fixture.pages(spark, sf_dir)
    model = training.trained_ranker(pages, F.col("stored"))
    return extract.extract(pages, rank=training.scoring(model))


#: A model of fixed weights, made by a rule.
_WEIGHTS = [((7 * k) % 11 - 5) / 4 for k in range(64)]


@query(
    f"""WITH e AS (SELECT vec_id, embedding, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS good FROM embeddings)
    SELECT vec_id, CASE WHEN good THEN round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {_WEIGHTS}[i])) - 0.125))), 9) END AS score FROM e"""
)
def embedding_scores(spark, sf_dir):
    """A logistic model over all embeddings, in batches, loaded once for each worker."""
    found = inference.scored(_read(spark, sf_dir, "embeddings"), "logistic-64", inference.linear(_WEIGHTS, -0.125), width=64)
    return found.select("vec_id", F.round("score", 9).alias("score"))


_EXPECTED = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN max(version) WHEN page_id % 3 = 1 THEN min(version) ELSE '99.9' END AS expected FROM @cands GROUP BY page_id"
_BEST = f"""WITH s AS (SELECT page_id, version, 'likely' AS model, CAST(prob AS DOUBLE) AS score FROM @cands UNION ALL SELECT page_id, version, 'points', CAST(points AS DOUBLE) FROM @cands),
    x AS ({_EXPECTED} UNION ALL SELECT -1, '1.0'),
    o AS (SELECT s.*, expected, regexp_replace(version, '^[vV]', '') AS a, regexp_replace(expected, '^[vV]', '') AS b FROM s JOIN x USING (page_id)),
    k AS (SELECT *, a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.') AS ok FROM o),
    f AS (SELECT *, max(ok::INT) OVER (PARTITION BY model, page_id) = 1 AS pool FROM k QUALIFY row_number() OVER (PARTITION BY model, page_id ORDER BY score DESC, version) = 1)"""


def _two_models(spark, sf_dir):
    rows = _cands(spark, sf_dir)
    one = lambda name, score: rows.select("page_id", "version", F.lit(name).alias("model"), score.cast("double").alias("score"))
    expected = rows.groupBy("page_id").agg(F.when(F.col("page_id") % 3 == 0, F.max("version")).when(F.col("page_id") % 3 == 1, F.min("version")).otherwise("99.9").alias("expected"))
    return one("likely", F.col("prob")).unionByName(one("points", F.col("points"))), expected.unionByName(spark.sql("SELECT -1L AS page_id, '1.0' AS expected"))


@query(
    _BEST
    + """ SELECT model, (SELECT count(*) FROM x) AS pages, CAST(count_if(ok) AS BIGINT) AS hits, round(count_if(ok) / (SELECT count(*) FROM x), 6) AS share, CAST(count_if(pool) AS BIGINT) AS pool, CAST(count_if(pool AND ok) AS BIGINT) AS pool_hits,
      CASE WHEN count_if(pool) > 0 THEN round(count_if(pool AND ok) / count_if(pool), 6) ELSE 0 END AS pool_share FROM f GROUP BY model"""
)
def holdout_models(spark, sf_dir):
    """How often the choices of two models are the expected version."""
    return evaluate.holdout(*_two_models(spark, sf_dir))


@query(
    _BEST
    + """ SELECT p.page_id, p.expected, p.version AS old_version, p.score AS old_score, q.version AS new_version, q.score AS new_score, CASE WHEN p.ok = q.ok THEN 'same' WHEN q.ok THEN 'better' ELSE 'worse' END AS change
    FROM f p JOIN f q ON p.page_id = q.page_id AND p.model = 'likely' AND q.model = 'points'"""
)
def holdout_changes(spark, sf_dir):
    """Pages where one model's choice gets better or worse than another's."""
    return evaluate.changes(*_two_models(spark, sf_dir), "likely", "points")
