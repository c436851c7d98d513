"""Files in and out: JSON, JSONL, page snapshots, JDBC, the audit's tables, trained models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The audit's tables; rows of one page lie together.
EXTRACTIONS = "id string, url string, ts timestamp, product string, version string, confidence string, source string, llm_triggered boolean, llm_answer string"
CANDIDATES = "id string, version string, score double, scopes array<string>, context string, rank int"


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The objects of JSON files that hold one array, or one object, each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The objects of JSONL files, blank lines left out."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, **of: Column) -> DataFrame:
    """One row, json: the given aggregates of df as an object."""
    return df.agg(*[c.alias(k) for k, c in of.items()]).select(F.to_json(F.struct(*of), {"ignoreNullFields": "false"}).alias("json"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").text(path)


def snapshot_id(url: Column) -> Column:
    """A page's id among snapshots: the first 12 hex digits of its URL's SHA-1."""
    return F.left(F.sha1(url.cast("binary")), F.lit(12))


def write_snapshots(pages: DataFrame, path: str) -> None:
    """Pages (url, html) of which there is html, as one file each in batches of a table, by id."""
    pages.where("html is not null").select(snapshot_id(F.col("url")).alias("id"), "url", "html").write.mode("overwrite").parquet(path)


def snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, url, html, batch): each page's snapshot from the first of several batches that has it."""
    rows = None
    for k, path in enumerate(paths):
        own = spark.read.parquet(path).withColumn("batch", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("batch", "url"))).where("k = 1").drop("k")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, html) of HTML files, named by id."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("id"), F.col("value").alias("html"))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database's table or query; with a numeric key and its bounds read in parts at once. Filters go to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def create_audit(spark: SparkSession, path: str) -> None:
    """Empty tables of the audit under path, if there are none."""
    for name, schema in (("extractions", EXTRACTIONS), ("candidates", CANDIDATES)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The audit's extractions and candidates."""
    return spark.read.schema(EXTRACTIONS).parquet(f"{path}/extractions"), spark.read.schema(CANDIDATES).parquet(f"{path}/candidates")


def response(df: DataFrame, *columns: str) -> DataFrame:
    """json: each row's answer, of these columns only."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def save_model(model: PipelineModel, path: str, kind: str, features: list[str], manifest: str) -> None:
    """A model and what it was made of: kind (filter or rank), its features in order, the manifest's SHA-256."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame([(kind, features, manifest)], "kind string, features array<string>, manifest string")
    meta.select("kind", "features", F.sha2(F.col("manifest").cast("binary"), 256).alias("manifest_hash")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str, kind: str) -> tuple[PipelineModel, list[str]]:
    """A saved model and its features; a model of another kind is an error."""
    meta = SparkSession.active().read.json(f"{path}/meta").first()
    if meta["kind"] != kind:
        raise ValueError(f"{path} has a {meta['kind']} model, not a {kind} one")
    return PipelineModel.load(f"{path}/model"), list(meta["features"])
