"""MinHash near-duplicates with tensored banding.

Two collections of ``TABLES`` half keys are computed for a text, each from
``WIDTH`` minhashes; a table key is a pair of half keys, one of either collection.
So 2 * TABLES * WIDTH = 48 minhashes give TABLES ** 2 = 64 tables of 6 minhashes
each. A pair of similarity s shares a table with probability
(1 - (1 - s**3)**8)**2: 0.999 at 0.85, 0.9999 at 0.9.

Texts with equal sets are first put together as one class; every candidate pair of
classes is confirmed on full sets. In a table, each class is compared with one head,
another in each table. Tables that this leaves in more than one component are open:
two sets of similarity s share one of the (1 - s) * n + 1 rarest shingles of either,
so the classes of open tables are compared, across components only, with those that
share such a shingle. No link of a table is lost, and groups of copies aren't expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import batches, bounded, components, keyed, lean, table
from ._text import U, bytes_of, mix, per_text, runs, split_words, splitmix, windows, word_runs

TABLES, WIDTH = 8, 3
SHINGLE, SIMILARITY = 5, 0.8
#: Members of a table that one task compares with as many others in the second pass.
BLOCK = 512


def _sets(words, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, first = windows(words, size)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (a 128-bit print of the set), half (its half keys).

    Null, empty and blank texts have no shingles and null prints.
    """
    seeds = splitmix(2024, 2 * TABLES * WIDTH)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, words in word_runs(batch.column(1), limit=1 << 20):
                sets = _sets(words, shingle)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                h = np.concatenate(sets) if sets else np.empty(0, dtype=U)
                first = np.concatenate([[0], np.cumsum(sizes)])
                fp1, fp2 = per_text(h, first, np.add, 0), per_text(mix(h ^ U(99)), first, np.bitwise_xor, 0)
                half = np.zeros((2 * TABLES, len(sets)), dtype=U)
                for k, seed in enumerate(seeds):
                    x = h ^ seed
                    x *= U(0xD6E8FEB86659FD93)
                    x ^= x >> U(32)
                    x *= U(0xD6E8FEB86659FD93)
                    half[k // WIDTH] = mix(half[k // WIDTH] * U(31) + per_text(x, first, np.minimum, 0) + U(k))
                none = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(fp1.view(np.int64), mask=none), pa.array(fp2.view(np.int64), mask=none), pa.array([x.tobytes() for x in np.ascontiguousarray(half.T)], pa.binary())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "half"],
                )

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, fp1 long, fp2 long, half binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full sets are similar enough."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    some = texts.join(bounded(ids, 16), "doc_id", "left_semi")
    rows = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in it:
            keep = np.zeros(batch.num_rows, dtype=bool)
            ids = batch.column(0).to_pylist()
            (da, oa), (db, ob) = bytes_of(batch.column(2)), bytes_of(batch.column(3))
            for i, j in runs(ob):
                sets = _sets(split_words(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i]), shingle)
                for k in range(i, j):
                    text = da[oa[k] : oa[k + 1]]
                    if last[0] != ids[k] or len(last[2]) != len(text) or not np.array_equal(last[2], text):
                        last = ids[k], _sets(split_words(text, np.array([0, len(text)])), shingle)[0], text.copy()
                    x, y = last[1], sets[k - i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return batches(rows.select("a", "b", "ta", "tb"), run, "a long, b long")


def _size_can(percent: int):
    """Whether sets of na and nb members can reach the similarity."""
    return (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to.

    A text without words is linked with nothing and has its own id. Rows with a null
    doc_id take no part in links (component_id null). Rows that repeat a doc_id share a
    component. Other columns of docs are not read.
    """
    percent = round(similarity * 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = table(signatures(texts, shingle))
    some = signs.where("n_shingles > 0 and doc_id is not null")
    # one class for each distinct set
    prints = table(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")))
    twice = some.groupBy("doc_id").agg(F.count_distinct("fp1", "fp2").alias("n")).where("n > 1").select("doc_id")
    heads = some.join(prints.select("fp1", "fp2", F.col("rep").alias("doc_id")), ["fp1", "fp2", "doc_id"], "left_semi")
    groups = _tables(heads.select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "half").dropDuplicates(["rep", "half"]))
    pairs = table(groups.where(_size_can(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = table(_confirmed(pairs, texts, shingle, percent))
    labels = components(links)
    open_ = table(_open(groups, labels))
    more = table(_across(_rarest(open_, texts, shingle, percent), percent).join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = table(links.unionByName(_confirmed(more, texts, shingle, percent)))
        labels = components(links)
    same = some.join(twice, "doc_id", "left_semi").join(prints, ["fp1", "fp2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    same = table(same.distinct())
    if same.limit(1).count():
        labels = components(links.unionByName(same))
    of = prints.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("label", "rep").alias("label"))
    return signs.join(of, ["fp1", "fp2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one of each component: that of the smallest doc_id.

    Texts without words and rows with a null doc_id stay; of rows with one doc_id, one stays.
    """
    found = table(classes(docs, similarity=similarity))
    gone = table(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(bounded(gone.withColumnRenamed("doc_id", "_gone"), 16), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    twice = table(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"))
    if not twice.limit(1).count():
        return kept
    same = F.col("doc_id").cast("long") == F.col("_twice")
    one = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, same, "left_anti").unionByName(one)


def _tables(heads: DataFrame) -> DataFrame:
    """(key, a, b, na, nb): a is the head of table key as far as seen, b another class in it.

    A task first puts its own classes together: a key leaves it as one row, its head,
    with pairs of that and each other class, which need no further grouping. So a key
    that very many classes share isn't gathered anywhere. Heads are drawn by a hash of
    key and class: a group that shares many tables has many different heads.
    """

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, TABLES * TABLES + 1, dtype=U))
        for batch in it:
            rep, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            half = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=U).reshape(-1, 2 * TABLES)
            key = mix(half[:, :TABLES, None] * U(0x9E3779B97F4A7C15) + mix(half[:, None, TABLES:] ^ U(5)) + place.reshape(1, TABLES, TABLES)).reshape(-1).view(np.int64)
            rep, n = np.repeat(rep, TABLES * TABLES), np.repeat(n, TABLES * TABLES)
            order = np.lexsort((mix(rep.view(U) ^ key.view(U)), key))
            key, rep, n = key[order], rep[order], n[order]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(head)[np.cumsum(head) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep[at]), pa.array(rep, mask=head), pa.array(n[at]), pa.array(n, mask=head)], names=["key", "a", "b", "na", "nb"])

    def far(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the key at hand and its head
        for batch in it:
            done = batch.filter(batch.column(2).is_valid())
            heads = batch.filter(batch.column(2).is_null())
            key, a, na = (heads.column(k).to_numpy() for k in (0, 1, 3))
            if len(key):
                head = np.ones(len(key), dtype=bool)
                head[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(head)[np.cumsum(head) - 1]
                x, nx = a[at], na[at]
                if last is not None and last[0] == key[0]:
                    x, nx = np.where(key == last[0], last[1], x), np.where(key == last[0], last[2], nx).astype(na.dtype)
                last = key[-1], x[-1], nx[-1]
                keep = x != a
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (key, x, a, nx, na)], names=["key", "a", "b", "na", "nb"])
            yield done

    spark = heads.sparkSession
    schema = "key long, a long, b long, na int, nb int"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = heads.mapInArrow(lean(near), schema)
    dealt = first.repartition(parts, F.coalesce("b", "key")).sortWithinPartitions("key", F.xxhash64("key", "a"), "a")
    return table(dealt.mapInArrow(lean(far), schema))


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(m, n, c): the classes of tables with more than one component, sizes of their sets, components."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("na").alias("n")), F.struct(F.col("b").alias("m"), F.col("nb").alias("n"))))
    members = groups.select("key", ends.alias("x")).select("key", "x.m", "x.n").distinct()
    members = table(members.join(labels.select(F.col("id").alias("m"), "label"), "m", "left").select("key", "m", "n", F.coalesce("label", "m").alias("c")))
    mixed = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return members.join(mixed, "key", "left_semi").select("m", "n", "c").distinct()


def _rarest(open_: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, m, n, c, at): the rarest shingles, as keys, of open classes, as far as others have them too.

    A set of n needs ceil(s * n) members in common with any other; so of its members by
    rising frequency, one of the first n - ceil(s * n) + 1 must be. at: its place in that order.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_numpy()
            for i, j, words in word_runs(batch.column(1), limit=1 << 18):
                sets = _sets(words, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], [len(x) for x in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["m", "key"])

    some = texts.join(bounded(open_.select(F.col("m").alias("doc_id")), 16), "doc_id", "left_semi")
    tokens = table(batches(some.select("doc_id", "text"), run, "m long, key long"))
    shared = table(tokens.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"))
    shared = keyed(tokens, shared, "key", "f").withColumns({"rank": F.row_number().over(Window.partitionBy("m").orderBy("f", "key")), "of": F.count("*").over(Window.partitionBy("m"))})
    least_common = F.floor((F.col("n") * percent + 99) / 100)
    at = F.col("rank") + F.col("n") - F.col("of")  # those that no other has come first
    return shared.join(open_, "m").where(at <= F.col("n") - least_common + 1).select("key", "m", "n", "c", at.cast("int").alias("at"))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one key in different components.

    Of a pair's common shingles the first must leave room, behind its places in both, for
    as many as the similarity takes: that is what keeps the pairs of a large group few.
    A key's members are dealt to blocks of about BLOCK, and tasks compare two blocks. Large
    components have blocks of their own, which aren't compared with each other.
    """
    members = table(members)
    per = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK
    per = per.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"), F.coalesce(F.ceil(F.sum(F.when(~large, F.col("n"))) / BLOCK), F.lit(0)).cast("int").alias("mixed"), F.array_sort(F.collect_list(F.when(large, F.struct("c", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))))).alias("large"))
    before = lambda i: F.aggregate(F.slice("large", F.lit(1), i), F.lit(0), lambda s, x: s + x["blocks"])
    large = F.transform("large", lambda x, i: F.struct(x["c"].alias("c"), x["blocks"].alias("blocks"), (F.col("mixed") + before(i)).alias("from")))
    per = table(per.where("kinds > 1").select("key", "size", "mixed", (F.col("mixed") + before(F.size("large"))).alias("all"), large.alias("large")))
    dealt = keyed(members, per, "key", "size").withColumn("own", F.get(F.filter("large", lambda x: x["c"] == F.col("c")), F.lit(0)))
    mine = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("c"), F.col("mixed"))).otherwise(F.col("own.from") + F.pmod(F.xxhash64("m"), F.col("own.blocks"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: F.col("own").isNull() | (k < F.col("own.from")) | (k >= F.col("own.from") + F.col("own.blocks")))
    dealt = dealt.withColumn("mine", mine).select("key", "m", "n", "c", "at", "mine", F.explode(others).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "m", "n", "c", "at")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def cross(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
            _, i, j, mine, m, n, c, at = np.concatenate(rows, axis=1)
            left, right = (np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0]))
            found = []
            for x in left:
                y = right if i[0] != j[0] else right[right > x]
                common = -(-percent * (n[y] + n[x]) // (100 + percent))
                y = y[(c[y] != c[x]) & (1 + np.minimum(n[y] - at[y], n[x] - at[x]) >= common)]
                found.append(np.stack([np.minimum(m[x], m[y]), np.maximum(m[x], m[y])]))
            a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in it:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(8)])
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            for part in np.split(rows, cuts, axis=1):
                if held and part.shape[1] and not np.array_equal(held[0][:3, 0], part[:3, 0]):
                    yield pairs(held)
                    held = []
                if part.shape[1]:
                    held.append(part)
        if held:
            yield pairs(held)

    return dealt.mapInArrow(lean(cross), "a long, b long").distinct()
