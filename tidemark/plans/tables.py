"""Tables between parts of a long plan, in the folder that all executors share, and joins of what grows with the pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir; on a local master only, one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tidemark_tables", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark._tidemark_tables = tempfile.mkdtemp(prefix="tidemark-")
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: a short plan from here on, and no recomputation."""
    path = f"{folder(df.sparkSession)}/plans/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right) by sorting both, whatever Spark guesses of their sizes: it counts any text as 20 characters, and broadcasts pages made from a small table."""
    return left.join(right.hint("merge"), on, how)
