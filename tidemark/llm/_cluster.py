"""Spark helpers of the operators: tables in the shared folder, bounded joins, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is counted and has at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Shuffle files go when the job that wrote a table is done.
WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of a batch for Python, where the session has Spark's default: executors keep the memory of large ones.
BATCH_BYTES = 4 << 20
_BYTES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64MB", "64m")
#: Rows of texts that an operator's function gets at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on a local master only, one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_tidemark_dir", None) or tempfile.mkdtemp(prefix="tidemark-")
        spark._tidemark_dir = at
    return at.rstrip("/")


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside; then those of before."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    with _set(spark, WHILE_WRITTEN):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """table(), dealt by key to so many buckets, a file each: joins on the key with as many partitions leave it in place."""
    spark, name = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tidemark/{name}"
    with _set(spark, WHILE_WRITTEN):
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._tidemark_path, out._tidemark_name = path, name
    return out


def spent(*tables: DataFrame) -> None:
    """Free the disk of tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "_tidemark_name"):
            t.sparkSession.sql(f"DROP TABLE {t._tidemark_name}")
        t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(t._tidemark_path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(f: Callable) -> Callable:
    """f, after which a worker gives the memory it has freed back to the system: workers are kept for later tasks."""

    def run(it):
        try:
            yield from f(it)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow with at most BATCH_ROWS rows at once; workers give memory back.

    If the session has no size of batches of its own, it gets BATCH_BYTES from here on, as plans run later.
    """
    if df.sparkSession.conf.get(_BYTES) in _DEFAULT:
        df.sparkSession.conf.set(_BYTES, str(BATCH_BYTES))

    def run(it):
        return f(batch.slice(i, BATCH_ROWS) for batch in it for i in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(lean(run), schema)


def bounded(df: DataFrame, bytes_per_row: int, more: Column | None = None) -> DataFrame:
    """df (of a table), with a broadcast hint if its counted size allows; else Spark joins by shuffle.

    more: bytes of a row's arrays.
    """
    size = F.lit(bytes_per_row) if more is None else F.lit(bytes_per_row) + more
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df.hint("merge")


def keyed(rows: DataFrame, per: DataFrame, key: str, size: str) -> DataFrame:
    """rows (a table) joined with per, a row for each key, size: how many of rows it has.

    Keys of so many rows that they are few are broadcast, their rows stay where they are;
    the others are joined by shuffle.
    """
    most = max(256, rows.count() * 64 // BROADCAST_BYTES)
    hot = F.broadcast(per.where(F.col(size) > most))
    cold = rows.join(hot, key, "left_anti").join(per.where(F.col(size) <= most).hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): for every id in an edge the smallest id reachable.

    Rounds of smallest neighbour's label and pointer jumping until nothing changes;
    each round's labels are a table in the shared folder. Star-shaped groups of any
    size take two rounds, chains of length n about log n.
    """
    both = table(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")).where("x <> y")).distinct())
    labels = table(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("label").alias("l")), "y").groupBy(F.col("x").alias("id")).agg(F.min("l").alias("l"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        after = table(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels


def crc32_of(c: Column) -> Column:
    """crc32 of an id as decimal text."""
    return F.crc32(c.cast("string").cast("binary"))
