"""WARC archives of pages: written, read back, and indexed by an external merge.

Each archive is a text file of Spark's own writer (records are UTF-8 and end with the
blank lines that separate records), so any file system that Spark writes to will do; it
is compressed as one stream, offsets are places in what it holds. Archives are read as a
stream of lines, of which one record at a time is held whole. Reading an archive gives a
capture run, sorted by URL key and timestamp; runs are dealt to ranges of keys of at most
about RANGE_ROWS captures, and in each range a tree of losers merges the runs' parts,
which Spark's sort, that may spill, has put one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import bounded, lean, shared_dir, table

#: Records of one archive at most.
RECORDS = 1000
RANGE_ROWS = 500_000
#: Captures are dated from here, a second for each page_id, by its remainder of some centuries.
EPOCH, SECONDS = 1_600_000_000, 1 << 33
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(c: Column) -> Column:
    """SHA-1 of a binary column in base 32: 160 bits make 32 characters of 5."""
    digest = F.sha1(c)
    parts = []
    for k in range(4):  # 40 bits at a time
        bits = F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 2), 40, "0")
        parts += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def url_key(c: Column) -> Column:
    """The host's labels in reverse, comma-joined, then the rest: com,example,www)/path. Null and odd URLs keep their own text."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?#]*", 0)
    rest = F.regexp_replace(F.substring(bare, F.length(host) + 1, F.length(bare)), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, "^www\\.|:[0-9]+$", ""), "\\.")), ","), F.lit(")"), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, record: one WARC record for each row of pages.

    Of equal payloads of at least least_bytes bytes, that with the largest page_id is a
    response, the others are revisits of it; a null page_id is below all others. A null
    html is an empty payload. Rows that repeat give a record each, all of one type. Columns
    other than page_id, url and html aren't read. Payloads are moved only where there are
    too many repeated ones to broadcast their digests.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    largest = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(bounded(table(largest.select("digest", "kept")), 64), "digest", "left").withColumn("revisit", F.coalesce(F.col("bytes") >= least_bytes, F.lit(False)) & F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")))
    payload = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    sha = base32_sha1(F.col("html").cast("binary"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("kept").cast("string"), F.lit(">"))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT}")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("X-URL-Key: "), _one_line(url_key(F.col("url")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    ]
    # concat_ws leaves out nulls
    return rows.select("page_id", F.concat(F.concat_ws("\r\n", *lines), F.lit(END), payload).alias("record"))


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write pages as archives of at most RECORDS records under path; gives the path."""
    path = path or f"{shared_dir(pages.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    records(pages).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


def parse(lines: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record of an archive, given in parts between which END stood.

    Lengths are trusted, so payloads may hold anything.
    """
    end, held, at, need = END.encode(), bytearray(), 0, 0

    def whole(room: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """Records that are all there, but for at most room bytes of the last one's end."""
        nonlocal at, need
        while True:
            stop = held.find(end)
            if not need:
                if stop < 0:
                    return
                headers = _headers(held[:stop].decode(), at)
                need = stop + 4 + int(headers["Content-Length"]) + 4
            if len(held) + room < need:
                return
            yield at, _headers(held[:stop].decode(), at), bytes(held[stop + 4 : need - 4])
            del held[:need]
            at, need = at + need, 0

    for k, line in enumerate(lines):
        if k:
            held += end
        held += line
        yield from whole(0)
    yield from whole(4)
    if held:
        raise ValueError(f"an archive ends inside the record at {at}")


def _headers(text: str, at: int) -> dict[str, str]:
    version, *lines = text.split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    return {k: v for k, _, v in (x.partition(": ") for x in lines)}


_CAPTURE = "url_key string, date string, page_id long, digest string, type string, refers_to long, payload_bytes long, archive string, offset long"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path, each archive's in order of URL key, date and page_id.

    A response's digest and length are those of the payload that was read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((name, line.as_buffer()) for batch in it for name, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for name, own in itertools.groupby(lines, lambda x: x[0]):
            found = []
            for offset, h, payload in parse(line for _, line in own):
                page = h["WARC-Record-ID"][10:-1]
                if h["WARC-Type"] == "response":
                    digest, size, to = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), None
                else:
                    digest, size, to = h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"]), int(h["WARC-Refers-To"][10:-1])
                found.append((h.get("X-URL-Key", ""), h["WARC-Date"], int(page) if page else None, digest, h["WARC-Type"], to, size, name, offset))
            found.sort(key=_order)
            for i in range(0, len(found), 5000):
                yield _captures(found[i : i + 5000])

    # a compressed archive isn't split: its lines come in order, in one task
    return spark.read.option("lineSep", END).text(path).select("_metadata.file_name", "value").mapInArrow(lean(run), _CAPTURE)


def _order(x: tuple) -> tuple:
    return x[0], x[1], -1 if x[2] is None else x[2], x[7], x[8]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, (s, s, n, s, s, n, n, s, n), strict=True)], names=names)


def merge(inputs: list[Iterator], key: Callable) -> Iterator:
    """k sorted inputs in one order by a tree of losers: one comparison a level for each item.

    tree[0] is the winner; tree[i] the loser of the match at inner node i. An input that
    has ended loses to all others; of equal items, that of the earlier input comes first.
    """
    k = len(inputs)
    if not k:
        return
    ended = object()
    heads = [next(x, ended) for x in inputs]
    keys = [None if x is ended else key(x) for x in heads]

    def beats(a: int, b: int) -> bool:
        if heads[a] is ended or heads[b] is ended:
            return heads[b] is ended and (heads[a] is not ended or a < b)
        return keys[a] < keys[b] or keys[a] == keys[b] and a < b

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], tree[i] = (a, b) if beats(a, b) else (b, a)
    tree[0] = winners[1]
    while heads[tree[0]] is not ended:
        w = tree[0]
        yield heads[w]
        heads[w] = next(inputs[w], ended)
        keys[w] = None if heads[w] is ended else key(heads[w])
        i = (w + k) // 2
        while i:
            if beats(tree[i], w):
                tree[i], w = w, tree[i]
            i //= 2
        tree[0] = w


def index(captures: DataFrame) -> DataFrame:
    """All captures in order of URL key, date and page_id, over partitions too.

    captures (a table) holds runs, rows of one archive in order. Ranges are cut by all
    three columns, then by archive and offset, so that the captures of one URL may be in
    several.
    """

    def rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield from zip(*[c.to_pylist() for c in batch.slice(i, 500).columns], strict=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range's part of each run, as slices of the batches that came
        parts: dict[str, list[pa.RecordBatch]] = {}
        for batch in it:
            archive = batch.column(7).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(archive[1:] != archive[:-1]) + 1).tolist(), len(archive)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    parts.setdefault(archive[a], []).append(batch.slice(a, b - a))
        out = []
        for row in merge([rows(x) for x in parts.values()], _order):
            out.append(row)
            if len(out) == 5000:
                yield _captures(out)
                out = []
        if out:
            yield _captures(out)

    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    key = ["url_key", "date", "page_id", "archive", "offset"]
    return captures.repartitionByRange(parts, *key).sortWithinPartitions("archive", *key).mapInArrow(lean(run), _CAPTURE)


def round_trip(pages: DataFrame) -> DataFrame:
    """The index of archives that pages are written to."""
    spark = pages.sparkSession
    return index(table(runs(spark, write(pages))))
