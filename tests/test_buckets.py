"""The table by buckets and the streams that keep state: what isn't touched stays, and restarts lose nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import buckets
from tidemark.streaming import audit

SCHEMA = "id string, ts long, value string"


def _files(at):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{at}/data") for f in names if f.startswith("part-")}


def _same(spark, at, want):
    assert {r.id: (r.ts, r.value) for r in buckets.current(spark, at, SCHEMA).collect()} == want


def test_upserts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "DIGITS", 1)
    at, rng, want = str(tmp_path / "audit"), random.Random(4), {}
    assert buckets.current(spark, at, SCHEMA).count() == 0
    for number in range(4):
        rows = [(f"i{rng.randrange(60)}", rng.randrange(9), f"b{number}r{k}") for k in range(40 if number == 0 else 4)] if number != 2 else []
        rows = list({(i, t): (i, t, v) for i, t, v in rows}.values())
        before = _files(at)
        touched = buckets.upsert(spark.createDataFrame(rows, SCHEMA), at, number)
        for i, t, v in sorted(rows, key=lambda r: r[1]):
            if i not in want or t >= want[i][0]:
                want[i] = (t, v)
        _same(spark, at, want)
        # nothing that was there is written again, and only touched buckets get files
        after = _files(at)
        assert before.items() <= after.items() and {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == set(touched)
        assert len(touched) <= (16 if number == 0 else 4)
    gone = buckets.unused(spark, at, keep=1)
    assert gone and not {(b, n) for b, n in buckets.places(spark, at).items()} & set(gone)


def test_batch_again(spark, tmp_path, monkeypatch):
    """A batch that fails before its map changes nothing; one made twice counts once."""
    at = str(tmp_path / "audit")
    one, two = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA), spark.createDataFrame([("b", 2, "z"), ("c", 2, "w")], SCHEMA)
    buckets.upsert(one, at, 0)
    real = spark.createDataFrame

    def fails(*args, **named):
        if len(args) > 1 and args[1] == "bucket string, of int":
            raise RuntimeError("lost")
        return real(*args, **named)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, *a, **k: fails(*a, **k))
        with pytest.raises(RuntimeError):
            buckets.upsert(two, at, 1)
    _same(spark, at, {"a": (1, "x"), "b": (1, "y")})
    for _ in range(2):
        buckets.upsert(two, at, 1)
        _same(spark, at, {"a": (1, "x"), "b": (2, "z"), "c": (2, "w")})
    # an earlier batch made again, as after a restart from an old checkpoint, sees what came before it
    buckets.upsert(one, at, 0)
    assert buckets.places(spark, at, 1).keys() == {r[0] for r in one.select(buckets.bucket(F.col("id"))).collect()}


def _put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_audit_stream(spark, tmp_path):
    """Batches of a page stream, a restart between them."""
    schema = "page_id long, url string, html string, ts string"
    pages, at, state = (str(tmp_path / x) for x in ("in", "audit", "state"))
    _put(spark, pages, [(1, "u", "<title>tool 1.0.0</title>", "2026-01-01 00:00:00"), (3, "w", None, "2026-01-01 00:00:00")], schema)
    assert audit.keep_audit(audit.page_stream(spark, pages), at, state).awaitTermination(120)
    kept = {f for f in _files(at)}
    _put(spark, pages, [(2, "u", "<title>tool 2.0.0</title>", "2026-01-02 00:00:00"), (4, "n", "<title>tool 4.0.0</title>", "2026-01-02 00:00:00")], schema)
    assert audit.keep_audit(audit.page_stream(spark, pages), at, state).awaitTermination(120)
    assert {(r.url, r.version) for r in audit.audit_table(spark, at).collect()} == {("u", "v2.0.0"), ("w", None), ("n", "v4.0.0")} and kept < set(_files(at))
    # an older page that comes late doesn't take a newer one's place
    _put(spark, pages, [(0, "u", "<title>tool 0.5.0</title>", "2025-01-01 00:00:00")], schema)
    assert audit.keep_audit(audit.page_stream(spark, pages), at, state).awaitTermination(120)
    assert {r.version for r in audit.audit_table(spark, at).where("url = 'u'").collect()} == {"v2.0.0"}


def test_running_counts(spark, tmp_path):
    """Counters go on after a restart, and end when nothing has come for their time."""
    schema, folder, out, state = "page_id long, version string, ts string", *(str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        _put(spark, folder, rows, schema)
        found = []
        stream = spark.readStream.schema("page_id long, version string, ts timestamp").parquet(folder)
        q = audit.running_counts(stream, hours=1, late="1 minute").writeStream.outputMode("update").foreachBatch(lambda df, n: found.extend(tuple(r) for r in df.collect())).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(found)

    first = run([(1, "v1", "2026-01-01 00:00:00"), (1, "v1", "2026-01-01 00:01:00"), (1, "v2", "2026-01-01 00:00:00"), (2, "v9", "2026-01-01 00:00:00"), (2, None, "2026-01-01 00:00:00"), (None, "v1", "2026-01-01 00:00:00")])
    assert first == [(1, "v1", 2, False), (1, "v2", 1, False), (2, "v9", 1, False)]
    assert run([(1, "v1", "2026-01-01 00:30:00")]) == [(1, "v1", 3, False)]
    # two hours on: the counters of pages 1 and 2 end, that of page 3 begins
    ended = run([(3, "v5", "2026-01-01 03:00:00")])
    assert [x for x in ended if not x[3]] == [(3, "v5", 1, False)]
    ended += run([(3, "v5", "2026-01-01 03:01:00")])
    assert {x for x in ended if x[3]} == {(1, "v1", 3, True), (1, "v2", 1, True), (2, "v9", 1, True)}
    assert run([(1, "v1", "2026-01-01 03:02:00")]) == [(1, "v1", 1, False)]
