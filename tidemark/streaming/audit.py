"""Streams of pages (an addition of ours: extraction itself works on whole tables).

A folder of page files is read as a stream; each micro-batch is extracted as a table and
the audit keeps the latest entry of each URL.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import audit_id
from ..operators.heuristics import extracted
from ..sources import buckets

PAGES = "page_id long, url string, html string, ts timestamp"
ENTRIES = "id string, url string, ts timestamp, version string, confidence string"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGES).parquet(folder)


def entries(pages: DataFrame) -> DataFrame:
    """(id, url, ts, version, confidence) of a table of pages, the latest of each URL."""
    last = pages.groupBy("url").agg(F.max_by(F.struct("page_id", "html", "ts"), F.struct("ts", "page_id")).alias("p")).select("url", "p.page_id", "p.html", "p.ts")
    found = extracted(last.select("page_id", "html")).select("page_id", "version", "confidence")
    return last.join(found, "page_id").select(audit_id(F.col("url")).alias("id"), "url", "ts", "version", "confidence")


def keep_audit(stream: DataFrame, audit: str, checkpoint: str) -> StreamingQuery:
    """Put a page stream's entries into the audit under a folder (sources.buckets): each batch writes the buckets of its URLs only."""

    def batch(pages: DataFrame, number: int) -> None:
        buckets.upsert(entries(pages), audit, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_table(spark: SparkSession, audit: str) -> DataFrame:
    """The audit as the last batch left it."""
    return buckets.current(spark, audit, ENTRIES)


def version_counts(responses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of (page_id, version) in ten-minute windows of a stream with ts."""
    return responses.withWatermark("ts", late).groupBy(F.window("ts", "10 minutes"), "page_id", "version").count()


def running_counts(responses: DataFrame, hours: float = 24, late: str = "10 minutes") -> DataFrame:
    """(page_id, version, n, ended): how often each page's versions have come, from a stream of page_id, version, ts.

    The counter of a page is state of the stream, across restarts. It comes out anew for
    the versions of each batch; hours after its last response, by the stream's clock, it comes
    out once more, ended, and is forgotten. A null version isn't counted.
    """
    rows = responses.where("page_id is not null and version is not null").select(F.col("page_id").cast("long"), "version", "ts").withWatermark("ts", late)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last = state.get if state.exists else (json.dumps({}), 0)
        counts = json.loads(known)
        if state.hasTimedOut:
            state.remove()
            yield _counter(key[0], counts, counts, True)
            return
        new: Counter[str] = Counter()
        for b in batches:
            new.update(b["version"])
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        for v, n in new.items():
            counts[v] = counts.get(v, 0) + n
        state.update((json.dumps(counts), last))
        # never before the watermark, which may be far ahead of late rows
        state.setTimeoutTimestamp(max(last + int(hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield _counter(key[0], counts, new, False)

    return rows.groupBy("page_id").applyInPandasWithState(count, "page_id long, version string, n long, ended boolean", "counts string, last long", "update", "EventTimeTimeout")


def _counter(page_id: int, counts: dict[str, int], shown, ended: bool) -> pd.DataFrame:
    versions = sorted(shown)
    return pd.DataFrame({"page_id": [page_id] * len(versions), "version": versions, "n": [counts[v] for v in versions], "ended": [ended] * len(versions)})
