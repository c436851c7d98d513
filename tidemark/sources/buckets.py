"""A table of rows by id that is changed in place: only buckets of ids that changed are written.

Under a folder, data/batch=.../bucket=... has what a batch made of the buckets that it
touched, and maps/batch=... which batch has the current rows of each bucket. The map is
written last: until then a batch changes nothing, and one that is made again takes the
place of its own earlier try. Files of buckets that aren't touched stay as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of an id's hash that name its bucket: 256 buckets.
DIGITS = 2


def bucket(id_: Column) -> Column:
    return F.left(F.sha1(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(DIGITS))


def places(spark: SparkSession, at: str, before: int | None = None) -> dict[str, int]:
    """The batch that has the rows of each bucket, as the last batch (under before) left it."""
    try:
        maps = spark.read.schema("bucket string, of int, batch int").parquet(f"{at}/maps")
        if before is not None:
            maps = maps.where(F.col("batch") < before)
        last = maps.agg(F.max("batch").alias("batch")).first()["batch"]
        return {} if last is None else {r["bucket"]: r["of"] for r in maps.where(F.col("batch") == last).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def rows_of(spark: SparkSession, at: str, schema, where: dict[str, int]) -> DataFrame:
    """The rows of buckets in the batches that are given."""
    paths = [f"{at}/data/batch={n}/bucket={b}" for b, n in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, at: str, schema) -> DataFrame:
    """The table as the last batch left it; empty if there is none."""
    return rows_of(spark, at, schema, places(spark, at))


def upsert(new: DataFrame, at: str, number: int, by: str = "id", order: tuple[str, ...] = ("ts",)) -> list[str]:
    """Put rows into the table as batch number: of each id the row of the greatest order stays, stored or new, a new one of equal ones. The buckets that were written."""
    spark = new.sparkSession
    before = places(spark, at, number)
    touched = sorted(r[0] for r in new.select(bucket(F.col(by)).alias("b")).distinct().collect())
    if touched or number == 0:
        old = rows_of(spark, at, new.schema, {b: before[b] for b in touched if b in before})
        rank = F.struct(*order, "_new")
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        last = both.groupBy(by).agg(F.max_by(F.struct(*new.columns), rank).alias("row")).select("row.*")
        # a bucket's rows in one file, all buckets at once
        parted = last.withColumn("bucket", bucket(F.col(by)))
        parted.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/data/batch={number}")
    after = before | dict.fromkeys(touched, number)
    spark.createDataFrame([(b, n) for b, n in sorted(after.items())], "bucket string, of int").coalesce(1).write.mode("overwrite").parquet(f"{at}/maps/batch={number}")
    return touched


def unused(spark: SparkSession, at: str, keep: int = 2) -> list[tuple[str, int]]:
    """(bucket, batch) of data that none of the last keep maps points to, which may be deleted."""
    maps = spark.read.schema("bucket string, of int, batch int").parquet(f"{at}/maps")
    kept = [r["batch"] for r in maps.select("batch").distinct().orderBy(F.desc("batch")).limit(keep).collect()]
    used = {(r["bucket"], r["of"]) for r in maps.where(F.col("batch").isin(kept)).select("bucket", "of").distinct().collect()}
    there = {(r["bucket"], r["batch"]) for r in spark.read.schema("bucket string, batch int").parquet(f"{at}/data").select("bucket", "batch").distinct().collect()}
    return sorted(there - used)
