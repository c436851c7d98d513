"""Similarity join of shingle sets by a token-group matrix.

Similar texts are put into groups, each with the union of its members' shingles: a row of
the matrix. A set can be similar to a member only if it has enough shingles in common with
the union, so a set is held against unions, and only groups that qualify are opened and
their members compared in full.

1. Texts with equal sets are one. Sets of which too few of the smallest shingle hashes
   occur in another set are similar to none and go no further.
2. The others are ordered by a minhash and cut into groups of at most ``GROUP`` sets that
   share it. A set is compared, until one is similar, with those that most sets of this
   minhash were like and with its own group: that makes most links of large groups of copies. Further rounds do the same to one set of each component,
   with other minhashes, while that joins many.
3. What remains are links between components. Shingles that only one component has can't
   make any. By rising frequency of the others, one of the first n - ceil(s * n) + 1 of a
   set of n must be among the first ones of a member of a group. Such pairs of a set and a
   group, with enough room for more behind these places, are held against the union; a set
   asks only groups that have members of larger components than its own, so that a
   component of any size isn't expanded.

Step 3 covers every pair of sets in different components, whatever the steps before have
found: the components are exactly those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import BROADCAST_BYTES, batches, bounded, components, keyed, spent, table
from ._text import U, mix, splitmix, windows, word_runs

SHINGLE, SIMILARITY = 5, 0.8
#: Sets and shingles of a group; one larger set makes a group of its own.
GROUP, GROUP_SHINGLES = 64, 1 << 17
#: Sets of a minhash's earlier groups that a new one is compared with, in step 2.
FIRST = 8
#: Minhashes to order by: a round each.
ROUNDS = 6
#: A further round is made while the one before has joined this share of its sets.
WORTH = 0.02


def _distinct(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) over runs of a column."""
    for i, _, words in word_runs(column, limit=1 << 20):
        h, first = windows(words, shingle)
        yield i, [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _print(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two parts."""
    one = np.array([x.sum(dtype=U) for x in sets], dtype=U)
    two = np.array([np.bitwise_xor.reduce(mix(x ^ U(99))) if len(x) else 0 for x in sets], dtype=U)
    return one.view(np.int64), two.view(np.int64)


def _least(n: int, percent: int) -> int:
    """Members that a set of n has in common with a similar one, at least."""
    return -(-percent * n // 100)


def _head(n: int, percent: int) -> tuple[int, int]:
    """Of the smallest members of a set of n: how many are looked at, and how many of them a similar set has among its own.

    The first k common members of two sets are within the first n - common + k of either.
    """
    k, of_smaller = max(1, n // 10), max(1, _least(n, percent) // 10)
    return min(n, n - _least(n, percent) + k), of_smaller


def prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (a 128-bit print of the set, null if empty), head (its smallest members)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, sets in _distinct(batch.column(1), shingle):
                none = np.array([not len(x) for x in sets], dtype=bool)
                one, two = _print(sets)
                head = [x[: _head(len(x), percent)[0]].view(np.int64) for x in sets]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in head])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(one, mask=none), pa.array(two, mask=none), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(head)))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "head"],
                )

    return batches(docs, run, "doc_id long, n_shingles long, fp1 long, fp2 long, head array<long>")


def _least_of(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _survivors(heads: DataFrame, percent: int) -> DataFrame:
    """The rows (m, doc_id, fp1, fp2) of sets (and n, head) with enough of head in the heads of others."""
    rows = heads.select("m", F.explode("head").alias("key"))
    shared = table(rows.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"))
    found = keyed(rows, shared, "key", "f").groupBy("m").agg(F.count("*").alias("had"))
    enough = F.greatest(F.lit(1), F.floor(_least_of(F.col("n"), percent) / 10))
    out = table(heads.select("m", "doc_id", "fp1", "fp2", "n").join(found, "m").where(F.col("had") >= enough).drop("n", "had"))
    spent(shared)
    return out


def _full(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """m, n, order (its minhashes, one for each round) and set (sorted shingles, as bytes) of the sets (m, doc_id, fp1, fp2)."""
    seeds = splitmix(77, ROUNDS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, sets in _distinct(batch.column(0), shingle):
                # of several texts with one id, the one that is meant
                one, two = _print(sets)
                on = np.flatnonzero((batch.column(2).slice(i, len(sets)).to_numpy() == one) & (batch.column(3).slice(i, len(sets)).to_numpy() == two))
                sets = [sets[k] for k in on]
                order = np.array([[mix(x ^ s).min() for s in seeds] for x in sets], dtype=U).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(on + i)), pa.array([len(x) for x in sets], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(order.reshape(-1)), ROUNDS).cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["m", "n", "order", "set"],
                )

    some = texts.join(bounded(ids, 40), "doc_id").select("text", "m", "fp1", "fp2")
    return batches(some, run, "m long, n int, order array<long>, set binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted distinct x and y are; the shorter is looked up in the longer."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _grouped(sets: DataFrame, nth: int, percent: int) -> DataFrame:
    """Groups by the nth minhash: a table of g, members (ids), sizes, sets (behind each other), union, and links (a, b) found in it.

    Sets are dealt by ranges of minhash, size and id: a minhash that very many share is cut
    like any other. A task holds one group.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(members: list[int], own: list[np.ndarray], links: list[tuple[int, int]]) -> pa.RecordBatch:
            union = np.unique(np.concatenate(own)) if len(own) > 1 else own[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([members[0]], pa.int64()), pa.array([members], pa.list_(pa.int64())), pa.array([[len(x) for x in own]], pa.list_(pa.int32())), pa.array([b"".join(x.tobytes() for x in own)], pa.large_binary()).cast(pa.binary()), pa.array([union.tobytes()], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in links]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=["g", "members", "sizes", "sets", "union", "links"],
            )

        key, total, members, own, links, first = None, 0, [], [], [], []
        for batch in it:
            for k, m, n, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x = np.frombuffer(raw, dtype=U)
                if members and (k != key or len(members) == GROUP or total + n > GROUP_SHINGLES):
                    yield done(members, own, links)
                    total, members, own, links = 0, [], [], []
                if k != key:
                    key, first = k, []
                # those that most of this minhash's sets were like, in earlier groups too, then the group's others
                like = next((one for one in first if _similar(x, one[2], percent)), None)
                if like:
                    like[0] += 1
                    links.append((like[1], m))
                    first.sort(key=lambda one: -one[0])
                else:
                    other = next((k for k in range(len(own) - 1, -1, -1) if _similar(x, own[k], percent)), None)
                    if other is not None:
                        links.append((members[other], m))
                    # a new one takes the place of the one that fewest were like
                    first = [*first[: FIRST - 1], [int(other is not None), m, x]]
                members.append(m)
                own.append(x)
                total += n
        if members:
            yield done(members, own, links)

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select(F.col("order")[nth].alias("k"), "m", "n", "set")
    dealt = rows.repartitionByRange(parts, "k", "n", "m").sortWithinPartitions("k", "n", "m")
    return table(batches(dealt, run, "g long, members array<long>, sizes array<int>, sets binary, union binary, links array<struct<a:long,b:long>>"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (m, c), a table, with the components that links (a, b; of labels) lead to: each label's smallest."""
    new = components(links).where("id <> label").select(F.col("id").alias("c"), F.col("label").alias("to"))
    return table(labels.join(bounded(table(new), 16), "c", "left").select("m", F.coalesce("to", "c").alias("c")))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) of sets as links of their components, each once."""
    of = lambda x: labels.select(F.col("m").alias(x), F.col("c").alias(f"c{x}"))
    return table(links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())


def _first_shingles(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, m, n, c, g, w, at) of sets: the first shingles by rising frequency, of those that several components have.

    at: the shingle's place in the set, where those of one component only stand first.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            for i in range(0, len(own), 64):
                part = own[i : i + 64]
                of = pa.array(np.repeat(np.arange(i, i + len(part)), [len(x) for x in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(np.concatenate(part))], names=["m", "c", "key"])

    tokens = table(batches(sets.select("m", "set").join(bounded(known.select("m", "c"), 16), "m").select("m", "set", "c"), run, "m long, c long, key long"))
    mixed = table(tokens.groupBy("key").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "f"))
    few = mixed.count() * 24 <= BROADCAST_BYTES
    rows = tokens.select("m", "key").join(F.broadcast(mixed), "key") if few else keyed(tokens.select("m", "key"), mixed, "key", "f")
    rows = rows.withColumns({"rank": F.row_number().over(Window.partitionBy("m").orderBy("f", "key")), "of": F.count("*").over(Window.partitionBy("m"))})
    at = F.col("rank") + F.col("n") - F.col("of")
    out = table(rows.join(bounded(known, 56), "m").where(at <= F.col("n") - _least_of(F.col("n"), percent) + 1).select("key", "m", "n", "c", "g", "w", at.cast("int").alias("at")))
    spent(tokens, mixed)
    return out


def _allows(percent: int) -> Column:
    """Whether a set of n, of which a shingle has the place at, can be similar to one of lo to hi shingles with at most room behind that shingle."""
    n, p = F.col("n"), F.lit(percent)
    sizes = (100 * n >= p * F.col("lo")) & (100 * F.col("hi") >= p * n)
    # common members of sets of n and of the smallest size that can be similar
    smallest = F.greatest(F.col("lo"), _least_of(n, percent))
    common = F.ceil(p * (n + smallest) / (100 + percent))
    return sizes & (1 + F.least(n - F.col("at"), F.col("room")) >= common)


def _likeliest(rows: DataFrame, percent: int) -> DataFrame:
    """(m, c, g): for each set and each larger component that its first shingles allow, one group, by most shingles: the one to ask first."""
    n, at = F.col("n"), F.col("at")
    index = rows.groupBy("key", F.col("c").alias("of"), "w").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(n - at).alias("room"), F.min("g").alias("g")).withColumnRenamed("w", "most")
    found = rows.select("key", "m", "n", "c", "w", "at").join(index, "key").where((F.col("most") > F.col("w")) & _allows(percent))
    times = found.groupBy("m", "c", "of", "g").agg(F.count("*").alias("times"))
    return times.groupBy("m", "c", "of").agg(F.max_by("g", F.struct("times", "g")).alias("g")).select("m", "c", "g")


def _qualifying(rows: DataFrame, percent: int) -> DataFrame:
    """(m, c, g): all pairs of a set and a group of which the first shingles allow for a link to a larger component."""
    index = rows.groupBy("key", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("room"), F.max("w").alias("most"))
    found = rows.select("key", "m", "n", "c", "w", "at").join(index, "key")
    return found.where((F.col("most") > F.col("w")) & _allows(percent)).select("m", "c", "g").distinct()


def _known(labels: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """A table of m, n, c, g and w, by which components stand in an order, larger ones later."""
    size = table(labels.groupBy("c").agg(F.count("*").alias("of")))
    of = groups.select("g", F.explode("members").alias("m"))
    return table(keyed(labels, size, "c", "of").join(of, "m").join(sets.select("m", "n"), "m").select("m", "n", "c", "g", F.struct("of", "c").alias("w")))


def _rows_of(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Those of rows whose key is in wanted."""
    keys = table(wanted.select(key).distinct())
    return rows.join(bounded(keys, 8), key, "left_semi")


def _bounded_overlap(pairs: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs (m, c, g) whose group has enough of the set in its union."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, union) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                x, union = np.frombuffer(x, dtype=U), np.frombuffer(union, dtype=U)
                at = np.searchsorted(union, x)
                at[at == len(union)] = 0
                keep[k] = 100 * int((union[at] == x).sum()) >= percent * len(x)
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["m", "c", "g"]).filter(pa.array(keep))

    rows = pairs.join(_rows_of(pairs, sets.select("m", "set"), "m"), "m").join(_rows_of(pairs, groups.select("g", "union"), "g"), "g")
    return batches(rows.select("m", "c", "g", "set", "union"), run, "m long, c long, g long")


def _opened(pairs: DataFrame, sets: DataFrame, groups: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): of each pair of a set and a group one to each other component in the group that the set is similar to."""
    of = _rows_of(pairs, known.select("m", "c", "g"), "g").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("m", "c"))).alias("labels"))
    own = _rows_of(pairs, groups.select("g", "members", "sizes", "sets"), "g").join(of, "g")
    rows = pairs.join(_rows_of(pairs, sets.select("m", "set"), "m"), "m").join(own, "g")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = [], []
            for k in range(batch.num_rows):
                m, c, x, labels, members, sizes = (batch.column(i)[k].as_py() for i in range(6))
                x, labels = np.frombuffer(x, dtype=U), dict(labels)
                whole, seen, begin = np.frombuffer(batch.column(6)[k].as_buffer(), dtype=U), {c}, 0
                for other, n in zip(members, sizes, strict=True):
                    if labels[other] not in seen and _similar(x, whole[begin : begin + n], percent):
                        seen.add(labels[other])
                        a.append(m)
                        b.append(other)
                    begin += n
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return batches(rows.select("m", "c", "set", "labels", "members", "sizes", "sets"), run, "a long, b long")


def joined(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to.

    Two texts are linked if their sets of distinct shingles (runs of words, A-Z lower-cased;
    all words of a shorter text) have at least that Jaccard similarity, in whole percent.
    Texts without words have no set and no link. Rows with a null doc_id take no part
    (component_id null). Rows that repeat a doc_id share a component. Other columns of docs
    aren't read; an empty table gives no rows. One text is held whole.
    """
    percent = round(similarity * 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = table(prints(texts, shingle, percent))
    some = signs.where("n_shingles > 0 and doc_id is not null")
    # a number, m, for each distinct set
    reps = table(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("m", F.monotonically_increasing_id()))
    own = some.join(reps.drop("copies").hint("merge"), ["doc_id", "fp1", "fp2"]).select("m", "doc_id", "fp1", "fp2", F.col("n_shingles").alias("n"), "head")
    repeats = table(some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    repeated = repeats.limit(1).count() > 0
    heads = table(own.dropDuplicates(["m"]) if repeated else own)
    ids = _survivors(heads, percent)
    spent(heads)
    found = _full(ids, texts, shingle)
    sets = table(found.dropDuplicates(["m"]) if repeated else found)
    ids = ids.select("m")
    groups = _grouped(sets, 0, percent)
    labels = table(ids.withColumn("c", F.col("m")))
    labels = _merged(labels, _links_of(groups))
    left, nth = ids.count(), 1
    while nth < ROUNDS:
        # one set of each component
        lead = table(labels.where("m = c").select("m"))
        now = lead.count()
        if nth > 1 and left - now <= WORTH * left:
            break
        more = _grouped(sets.join(bounded(lead, 8), "m", "left_semi"), nth, percent)
        labels, left, nth = _merged(labels, _links_of(more)), now, nth + 1
        spent(more)
    known = _known(labels, groups, sets)
    rows = _first_shingles(sets, known, percent)
    # most links are found by one question to each component; the others need asking only if they still are
    for asked in (_likeliest, _qualifying):
        pairs = table(_bounded_overlap(table(asked(rows, percent)), sets, groups, percent))
        links = _between(table(_opened(pairs, sets, groups, known, percent)), labels)
        if links.limit(1).count():
            labels = _merged(labels, links)
            if asked is _likeliest:
                known = _known(labels, groups, sets)
                rows = table(rows.select("key", "m", "at").join(bounded(known, 56), "m"))
    if repeated:
        # sets of one id, those without a similar set too
        same = some.join(repeats, "doc_id", "left_semi").select("doc_id", "fp1", "fp2").distinct().join(reps.select("fp1", "fp2", "m"), ["fp1", "fp2"])
        same = table(same.select(F.col("m").alias("a"), F.min("m").over(Window.partitionBy("doc_id")).alias("b")).where("a <> b"))
        alone = same.select(F.explode(F.array("a", "b")).alias("m")).distinct().join(ids, "m", "left_anti")
        labels = table(labels.unionByName(alone.withColumn("c", F.col("m"))))
        labels = _merged(labels, _between(same, labels))
    spent(sets, groups)
    # the smallest doc_id of each component of several sets
    low = labels.join(reps.select("m", "doc_id"), "m")
    low = table(low.groupBy("c").agg(F.count("*").alias("of"), F.min("doc_id").alias("least")))
    label = keyed(labels, low, "c", "of").select("m", "least")
    label = table(reps.join(label, "m", "left").select("fp1", "fp2", "copies", F.coalesce("least", "doc_id").alias("label")))
    result = keyed(some.select("doc_id", "n_shingles", "fp1", "fp2"), label, ["fp1", "fp2"], "copies").select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    return result.unionByName(signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _links_of(groups: DataFrame) -> DataFrame:
    return table(groups.select(F.explode("links").alias("l")).select("l.a", "l.b"))
