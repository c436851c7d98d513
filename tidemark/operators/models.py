"""Trained models: the candidate filter, the page ranker and the pairwise ranker, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight, so that both labels weigh the same in all."""
    own = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(own), label).withColumn("weight", 1 / F.col("_n")).drop("_n")


def filter_model(rows: DataFrame, columns: list[str], rounds: int = 20, depth: int = 5) -> PipelineModel:
    """Boosted trees for the probability that a candidate is a product version."""
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), trees]).fit(balanced(rows))


def filtered(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prob."""
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def rank_model(rows: DataFrame, columns: list[str], rounds: int = 20, depth: int = 5) -> PipelineModel:
    """Boosted trees on graded labels (0, 1, 2 with gains 0, 1, 3)."""
    trees = GBTRegressor(labelCol="gain", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42)
    graded = rows.withColumn("gain", F.pow(F.lit(2.0), F.col("label")) - 1)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), trees]).fit(graded)


def embedding_model(train: DataFrame, validation: DataFrame, strengths: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.1, 1.0)) -> tuple[PipelineModel, float]:
    """Logistic regression on embeddings (embedding, label), and its F1 on the validation rows: the regularisation that does best there."""
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label")).cache()
    best = None
    for strength in strengths:
        model = Pipeline(stages=[LogisticRegression(regParam=strength)]).fit(rows)
        found = model.transform(validation.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label")))
        n = found.agg(F.count_if(F.expr("prediction = 1 and label = 1")).alias("hit"), F.count_if(F.col("prediction") == 1).alias("said"), F.count_if(F.col("label") == 1).alias("true")).first()
        f1 = 2 * n["hit"] / max(1, n["said"] + n["true"])
        if best is None or f1 > best[1]:
            best = model, f1
    rows.unpersist()
    return best


def cosine_choice(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(page_id, id, cosine): of each page's vectors (page_id, id, embedding) the one nearest to its query (page_id, query); the least id of equal ones, null vectors last."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("query"), F.col("query")))
    rows = vectors.join(queries, "page_id").select("page_id", "id", (dot(F.col("embedding"), F.col("query")) / F.nullif(size, F.lit(0.0))).alias("cosine"))
    best = rows.groupBy("page_id").agg(F.max(F.struct(F.coalesce("cosine", F.lit(-2.0)).alias("c"), (-F.col("id")).alias("i"))).alias("x"))
    return best.select("page_id", (-F.col("x.i")).alias("id"), F.when(F.col("x.c") > -2, F.col("x.c")).alias("cosine"))


def pair_model(pairs: DataFrame) -> PipelineModel:
    """Logistic regression on differences of vectors pos and neg, taken both ways."""
    diff = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    rows = pairs.select(diff("pos", "neg").alias("d"), F.lit(1.0).alias("label")).unionByName(pairs.select(diff("neg", "pos").alias("d"), F.lit(0.0).alias("label")))
    from pyspark.ml.functions import array_to_vector

    return Pipeline(stages=[LogisticRegression(regParam=0.01, fitIntercept=False)]).fit(rows.select(array_to_vector("d").alias("features"), "label"))
