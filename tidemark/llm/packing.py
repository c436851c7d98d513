"""Best-fit packing of token sequences by bin completion with branch and bound.

Sizes are whole numbers up to the capacity, so all pieces of one size are alike and the
plan is made on their counts, whatever the number of documents: bins are filled around
the largest size left, by fillings that no other dominates, in order of rising waste,
many equal bins at a time; branches that must waste more than the best solution so far
are cut, and best-fit packing gives the first such solution. The plan, a list of bin
patterns with multiplicities, is then dealt out to pieces by their ranks among their size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes_bpe import Encoder
from ._cluster import batches, bounded, table

CAPACITY, END_ID = 1024, 2
#: Steps of the search: fillings begun, members taken and sizes looked at, all branches together.
#: A search that ends before is complete. It bounds the plan's time (a second or two) and its
#: quality, not what is packed.
STEPS = 400_000


class _Ended(Exception):
    """The search has used its steps."""


class Steps:
    """Steps that are left; taking one that isn't ends the search."""

    def __init__(self, n: int):
        self.left = n

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise _Ended


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A table of doc_id, piece, start, length, ids_crc32, part, nth and, if keep_ids, ids.

    A text's ids, then END_ID, are one piece; if they are more than capacity, pieces of
    capacity with a shorter first one. part is a partition's number, nth a piece's rank
    among those of its length there. A null text is empty. Each row is cut alone.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        encoder = Encoder(tokenizer or default_tokenizer())
        end = np.array([END_ID], dtype="<u4")
        for batch in it:
            out: list[list] = [[] for _ in range(7)]
            ids_out, rows = [], []
            for row, ids in enumerate(encoder.encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                at, k = 0, 0
                while at < len(ids):
                    size = (len(ids) % capacity or capacity) if not at else capacity
                    own = ids[at : at + size]
                    rows.append(row)
                    for column, v in zip(out, (k, at, size, zlib.crc32(own.tobytes()), part, seen[size]), strict=False):
                        column.append(v)
                    if keep_ids:
                        ids_out.append(own)
                    seen[size] += 1
                    at, k = at + size, k + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(out, kinds, strict=False)]]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return table(batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (sizes, bins) patterns."""
    left = Counter({s: n for s, n in counts.items() if n})
    bins = Counter()  # open bins by content
    by_room: dict[int, list] = {}

    def put(content: tuple, n: int) -> None:
        if content not in bins:
            by_room.setdefault(capacity - sum(content), []).append(content)
        bins[content] += n

    def drop(content: tuple, n: int) -> None:
        bins[content] -= n
        if not bins[content]:
            del bins[content]
            by_room[capacity - sum(content)].remove(content)

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            room = next((r for r in range(size, capacity + 1) if by_room.get(r)), None)
            if room is None:
                fit = capacity // size
                if n >= fit:
                    put((size,) * fit, n // fit)
                if n % fit:
                    put((size,) * (n % fit), 1)
                break
            content = by_room[room][0]
            k = min(n, bins[content])
            drop(content, k)
            put((*content, size), k)
            n -= k
    return list(bins.items())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that are needed at least: by total, or with large and middle sizes apart."""
    sizes = sorted((s, n) for s, n in counts.items() if n)
    best = -(-sum(s * n for s, n in sizes) // capacity)
    for alpha in {s for s, _ in sizes if s <= capacity // 2} | {0}:
        huge = sum(n for s, n in sizes if s > capacity - alpha)
        large = sum(n for s, n in sizes if capacity // 2 < s <= capacity - alpha)
        room = sum((capacity - s) * n for s, n in sizes if capacity // 2 < s <= capacity - alpha)
        small = sum(s * n for s, n in sizes if alpha <= s <= capacity // 2)
        best = max(best, huge + large + max(0, -(-(small - room) // capacity)))
    return best


def _spread(bits: int, n: int) -> int:
    """bits, each also set at the n places above it."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


def _larger(one: int, more: int, slack: int) -> int:
    """Sizes (a bit each) that fit where a member stands, or none, if larger than it, or several, if no smaller than their sum.

    one: sizes of members; more: sums of several. Each dominating filling is reached by such
    exchanges, so that none with no such size to spare is dominated by any.
    """
    return _spread(more, slack) | (_spread(one | 1, slack - 1) << 1 if slack else 0)


def fillings(left: dict[int, int], room: int, steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill room with sizes of which left has some, by rising waste; larger members first.

    A branch is left as soon as its members so far could be exchanged for a size that is
    known to be spare, so that dominated fillings aren't walked one by one.
    """
    spend = steps.take if steps else lambda n: None
    sizes = sorted(s for s, n in left.items() if n and s <= room)
    spend(1 + len(sizes))
    mask = (1 << room + 1) - 1
    reach = [1]  # sums of the smallest k sizes
    below = [0]  # the smallest k sizes
    for s in sizes:
        bits, n, k = reach[-1], min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            bits |= bits << s * k & mask
            n -= k
            k *= 2
        reach.append(bits)
        below.append(below[-1] | 1 << s)

    def ways(at: int, total: int, own: tuple[int, ...], one: int, more: int, spare: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Those of the smallest at sizes; only what leads somewhere is tried. spare: larger sizes that are left."""
        spend(1)
        if not total:
            if not _larger(one, more, waste) & (spare | below[at]):
                yield own
            return
        for j in range(at, 0, -1):
            s = sizes[j - 1]
            skipped = spare | below[at] ^ below[j]
            # with k of s, k rising: once larger sizes can be had for them, they can for more
            begun = []
            most, one_, more_ = min(left[s], total // s), one, more
            for k in range(1, most + 1):
                spend(1)
                one_, more_ = one_ | 1 << s, (more_ | (one_ | more_) << s) & mask if one_ & 1 << s and k > 1 else (more_ | (one | more_) << s) & mask
                larger = _larger(one_, more_, waste)
                if larger & skipped:
                    break
                still = skipped | (1 << s) * (k < left[s])
                if not larger & still and reach[j - 1] >> total - k * s & 1:
                    begun.append((k, one_, more_, still))
            for k, one_k, more_k, still in reversed(begun):
                yield from ways(j - 1, total - k * s, own + (s,) * k, one_k, more_k, still, waste)
            if not reach[j - 1] >> total & 1:
                return

    for waste in range(room + 1):
        if reach[-1] >> room - waste & 1:
            yield from ways(len(sizes), room - waste, (), 0, 0, 0, waste)


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, bins) patterns that use exactly counts, in as few bins as were found.

    Best-fit packing is the first solution. A node of the search is a filling of the bin of
    the largest size left, in as many equal bins as there can be, or fewer on backtracking.
    The search ends where a solution meets the lower bound, where all branches are cut, or
    after so many steps; only then may the plan be other than the best there is.
    """
    budget = Steps(steps)
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    best_bins, least = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    left, path, waste = dict(counts), [], 0

    def take(own: tuple[int, ...], n: int) -> None:
        nonlocal waste
        waste += n * (capacity - sum(own))
        for s in own:
            left[s] = left.get(s, 0) - n
            if not left[s]:
                del left[s]

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings of the next bin and how many such bins, within the waste that a better solution can have."""
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        for own in fillings(rest, capacity - first, budget):
            own = (first, *own)
            lost = capacity - sum(own)
            n = min(left[s] // own.count(s) for s in set(own))
            if lost:
                n = min(n, ((best_bins - 1) * capacity - total - waste) // lost)
            if n <= 0:
                return  # later ones waste no less
            yield from ((own, k) for k in range(n, 0, -1))

    stack = [choices()]
    while stack and best_bins > least:
        if len(path) == len(stack):
            own, n = path.pop()
            take(own, -n)
        try:
            step = next(stack[-1], None)
            # the members are counted up and down
            budget.take(1 + 2 * len(step[0]) if step else 1)
        except _Ended:
            break
        if step is None:
            stack.pop()
            continue
        # the best may have become better since
        if waste + step[1] * (capacity - sum(step[0])) > (best_bins - 1) * capacity - total:
            continue
        take(*step)
        path.append(step)
        if left:
            stack.append(choices())
        else:
            best, best_bins = list(path), sum(n for _, n in path)
    return best


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where ranks go: from[k] of size size[k] and the ranks after it, to sequence[k] and those after, at offset[k]."""
    rows, sequence, used = [], 0, Counter()
    for own, n in patterns:
        at = 0
        for s in own:
            rows.append((s, used[s], sequence, at))
            used[s] += n
            at += s
        sequence += n
    rows.sort()
    names = ("size", "from", "sequence", "offset")
    return {k: np.array(v, dtype=np.int64) for k, v in zip(names, zip(*rows, strict=True) if rows else [()] * 4, strict=True)}


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: sequences of at most capacity ids, gapless from 0.

    An empty table gives no rows, rows that repeat are packed each, a null doc_id stays null;
    columns other than doc_id and text aren't read.
    """
    cut = pieces(docs, capacity, tokenizer, keep_ids)
    per = table(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    # at most capacity rows, however many documents
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # no more rows than bins of the search have members, whatever the number of documents
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = table(per.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")))
    rows = cut.join(bounded(ranks, 24), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        cuts = np.searchsorted(s["size"], np.arange(capacity + 2))
        for batch in it:
            length, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            at = np.empty(len(rank), dtype=np.int64)
            for size in np.unique(length):
                on = length == size
                a, b = cuts[size], cuts[size + 1]
                at[on] = a + np.searchsorted(s["from"][a:b], rank[on], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s["sequence"][at] + rank - s["from"][at]), pa.array(s["offset"][at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    wide = rows.select(*kept, "rank")
    schema = wide.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return batches(wide, place, schema)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each of at most capacity ids."""
    rows = packed(docs, capacity, tokenizer, keep_ids=True)
    own = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return own.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"))
