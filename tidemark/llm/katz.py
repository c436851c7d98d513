"""Language-model scores by Katz backoff over n-grams of any order.

Texts are kept in chunks of about CHUNK bytes (words as ranks in a chunk's vocabulary).
Counts of each order are gathered by an exchange between chunks and slices of keys: a
chunk sends each slice its distinct n-grams there (hashes, sorted, with their counts in
training texts) as one packed row; a slice adds the counts of all chunks, keeps them as a
part of the model's table of that order, and answers each chunk with the sums, in the
order asked. So no key is ever in more rows than there are chunks, whatever its
frequency, and chunks score their own tokens. Backoff weights of histories are summed the
same way: each n-gram is counted by the first chunk that has it, if some text that isn't
learned from has its history.

P(w) = d(c) c / N, what is left goes to one unknown word. P(w|h) = d(c) c / (c(h) + EXTRA)
for an n-gram seen c times; else P(w|h) = alpha(h) P(w|h'), h' the history without its
first word, where alpha makes all words sum to 1; a history that was never seen is
shortened at once. d(c) is the Good-Turing discount of counts up to K, by order. A text's
first words have as much history as there is, back to its start.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, bucketed, lean, spent, table
from ._text import U, mix, splitmix, word_runs

ORDER = 3
CHUNK = 3 << 20
K, EXTRA = 5, 0.01
END, START = splitmix(77, 2)
_DOC_BITS = 23


@functools.cache
def _zstd() -> tuple:
    """One compressor and decompressor for a worker's life."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Whole numbers, their bytes by significance, compressed; delta for rising ones."""
    x = x.astype(np.uint64)
    if delta and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return _zstd()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes, delta: bool = False) -> np.ndarray:
    x = np.frombuffer(_zstd()[1].decompress(b), dtype=np.uint8)
    x = np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if delta else x


def _pack_values(x: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones, then which of them each is."""
    values, of = np.unique(x, return_inverse=True)
    return np.int64(len(values)).tobytes() + values.tobytes() + _pack(of)


def _unpack_values(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, dtype=np.int64, count=1)[0])
    return np.frombuffer(b, dtype=np.float64, count=n, offset=8)[_unpack(b[8 + 8 * n :]).astype(np.int64)]


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts d(1..K) from n(1..K+1), the numbers of keys seen so often.

    Where those are too few for it, absolute discounts.
    """
    k = len(n) - 1
    if all(n):
        most = (k + 1) * n[k] / n[0]
        if most < 1:
            d = [((r + 1) * n[r] / (r * n[r - 1]) - most) / (1 - most) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [1 - off / r for r in range(1, k + 1)]


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(number, place) of the parts of sorted keys, by their first bits."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)) if bits else []
    cuts = [0, *cuts, len(keys)]
    for k in range(1 << bits):
        if cuts[k + 1] > cuts[k]:
            yield k, slice(cuts[k], cuts[k + 1])


def _longer(grams: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the histories and n-grams of an order that end at each token, from the n-grams of the order below.

    Where a text has too few words before a token, both are meaningless: see _there.
    """
    history = np.empty_like(grams)
    history[1:] = grams[:-1]
    history[np.cumsum(sizes) - sizes] = START
    return history, mix(history * U(0x9E3779B97F4A7C15) + tokens * U(0xC2B2AE3D27D4EB4F) + U(order))


def _there(sizes: np.ndarray, order: int) -> np.ndarray:
    """Whether a token has an n-gram of an order: its text's start and order - 2 words before it."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes) >= order - 2


_CHUNK = "chunk long, head binary, words binary, ranks binary"


def _chunks(docs: DataFrame, parts: int) -> DataFrame:
    """A table of chunks: head has the sizes, kinds and ids of their documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def chunk(held: list[tuple]) -> pa.RecordBatch:
            ids = [x for h in held for x in h[0]]
            train, sizes, tokens = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            words, of, seen = np.unique(tokens, return_inverse=True, return_counts=True)
            by_rank = np.argsort(-seen, kind="stable")
            rank = np.empty_like(by_rank)
            rank[by_rank] = np.arange(len(by_rank))
            null = np.array([x is None for x in ids])
            head = _pack(np.concatenate([[len(ids)], sizes, train, null, np.array([x or 0 for x in ids], dtype=np.int64).view(U)]).astype(U))
            return pa.RecordBatch.from_pylist([{"chunk": part << 12 | made, "head": head, "words": words[by_rank].tobytes(), "ranks": _pack(rank[of])}], pa.schema([("chunk", pa.int64()), ("head", pa.binary()), ("words", pa.binary()), ("ranks", pa.binary())]))

        held, size = [], 0
        for batch in it:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).to_pylist()
            for i, j, words in word_runs(batch.column(1)):
                held.append((ids[i:j], train[i:j], words.counts() + 1, np.insert(words.hash, words.first[1:], END)))
                size += len(words.data) + j - i
                if size >= CHUNK:
                    yield chunk(held)
                    made, held, size = made + 1, [], 0
        if held:
            yield chunk(held)

    return bucketed(batches(docs, run, _CHUNK), "chunk", parts)


def _opened(head: bytes, words: bytes, ranks: bytes) -> tuple[np.ndarray, ...]:
    """Sizes of a chunk's documents, whether they are learned from, ids, whether those are null, and all tokens."""
    head = _unpack(head)
    n = int(head[0])
    sizes, train, null, ids = (head[1 + k * n : 1 + (k + 1) * n].astype(np.int64) for k in range(4))
    return sizes, train.astype(bool), ids, null.astype(bool), np.frombuffer(words, dtype=U)[_unpack(ranks).astype(np.int64)]


def _grams(sizes: np.ndarray, tokens: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray | None, np.ndarray, np.ndarray]]:
    """(k, histories, n-grams, whether there) of every token, for k up to order."""
    grams = tokens
    yield 1, None, grams, np.ones(len(tokens), dtype=bool)
    for k in range(2, order + 1):
        history, grams = _longer(grams, sizes, tokens, k)
        yield k, history, grams, _there(sizes, k)


_ASK = "to long, slice int, chunk long, keys binary, counts binary, marks binary"
_ANSWER = "order int, chunk long, slice int, totals binary, first binary, wanted binary, stats array<long>"
_PARTS = [("order", pa.int32()), ("chunk", pa.int64()), ("slice", pa.int32()), ("totals", pa.binary()), ("first", pa.binary()), ("wanted", pa.binary()), ("stats", pa.list_(pa.int64()))]


def _to(k: int, seed: int) -> int:
    """Where a slice goes: any spread number."""
    return int(splitmix(k * 64 + seed, 1)[0] >> U(1))


def _groups(it: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Runs of rows with equal values in a column."""
    held: list[dict] = []
    for batch in it:
        for k in range(batch.num_rows):  # one at a time: rows are large
            row = batch.slice(k, 1).to_pylist()[0]
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(chunks: DataFrame, order: int, bits: int, parts: int, longer: bool) -> DataFrame:
    """A table of the answers to chunks about their n-grams of an order, and of slices' statistics (chunk null)."""

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row,) in _groups(it, "chunk"):
            sizes, train, _, _, tokens = _opened(row["head"], row["words"], row["ranks"])
            *_, (_, _, grams, there) = _grams(sizes, tokens, order)
            learns = np.repeat(train, sizes)[there]
            keys, of = np.unique(grams[there], return_inverse=True)
            del tokens, grams, there
            counts = np.bincount(of, learns, len(keys)).astype(np.int64)
            marks = np.bincount(of, ~learns, len(keys)) > 0  # it may be a history to back off from
            del of
            cut = list(_slices(keys, bits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_to(k, order) for k, _ in cut], pa.int64()), pa.array([k for k, _ in cut], pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()),
                    *(pa.array([f(at) for _, at in cut], pa.binary()) for f in (lambda at: _pack(keys[at], True), lambda at: _pack(counts[at]), lambda at: np.packbits(marks[at]).tobytes())),
                ],
                names=[x.split()[0] for x in _ASK.split(", ")],
            )

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, "slice"):
            keys = [_unpack(r["keys"], True) for r in group]
            counts = np.concatenate([_unpack(r["counts"]) for r in group]).astype(np.int64)
            marks = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], dtype=np.uint8), count=len(k)) for r, k in zip(group, keys, strict=True)])
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(of, counts, len(distinct)).astype(np.int64)
            wanted = np.bincount(of, marks, len(distinct)) > 0
            first = np.zeros(len(of), dtype=bool)  # the first training chunk of a key counts it in sums over distinct keys
            learned = np.flatnonzero(counts)
            first[learned[np.unique(of[learned], return_index=True)[1]]] = True
            at = 0
            for r, k in zip(group, keys, strict=True):
                own = slice(at, at + len(k))
                at += len(k)
                yield pa.RecordBatch.from_pylist([{"order": order, "chunk": r["chunk"], "slice": r["slice"], "totals": _pack(total[of[own]]), "first": np.packbits(first[own]).tobytes(), "wanted": np.packbits(wanted[of[own] if longer else []]).tobytes()}], pa.schema(_PARTS))
            stats = [*[int((total == r).sum()) for r in range(1, K + 2)], int(total.sum()), int((total > 0).sum())]
            yield pa.RecordBatch.from_pylist([{"order": order, "slice": group[0]["slice"], "stats": stats}], pa.schema(_PARTS))

    dealt = chunks.mapInArrow(lean(ask), _ASK).repartition(parts, "to").sortWithinPartitions("slice", "chunk")
    return table(dealt.mapInArrow(lean(answer), _ANSWER))


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(x, out=np.full(len(x), -np.inf), where=x > 0)


_SCORED = "kind string, uid long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, h long, n long, slice int, a binary, b binary, c binary, d binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
_FIELDS = [(name, _KINDS[kind]) for name, kind in (x.split() for x in _SCORED.split(", "))]


def _scored_rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])


def _chunk_scores(row: dict, stats: dict[int, list[int]], bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's documents (P), the histories they back off from (U) and its part of those histories' sums (H)."""
    number, order = row["chunk"], max(stats)
    sizes, train, ids, null, tokens = _opened(row["head"], row["words"], row["ranks"])
    n, starts = len(sizes), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    total, kinds = stats[1][K + 1], stats[1][K + 2]
    log_p = before = want = lower = None
    for k, history, grams, there in _grams(sizes, tokens, order):
        answers = sorted((r for r in row["answers"] or () if r["order"] == k), key=lambda r: r["slice"])
        _, one, of = np.unique(grams[there], return_index=True, return_inverse=True)
        totals = [_unpack(r["totals"]).astype(np.int64) for r in answers]
        first, wanted = (np.concatenate([np.unpackbits(np.frombuffer(r[x], dtype=np.uint8), count=len(t) if x == "first" or k < order else 0) for r, t in zip(answers, totals, strict=True)]).astype(bool) if totals else np.empty(0, dtype=bool) for x in ("first", "wanted"))
        totals = np.concatenate([np.empty(0, dtype=np.int64), *totals])
        count, own = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        count[there] = totals[of]
        if k < order:  # it may be a history
            own[there] = wanted[of]
        d = np.array([0.0, *discounts(stats[k][: K + 1])])
        kept = count * np.where(count <= K, d[np.minimum(count, K)], 1.0)
        if k == 1:
            left = max(sum((1 - d[r]) * r * stats[1][r - 1] for r in range(1, K + 1)) / total, 1e-12) if total else 1.0
            lower = kept / max(total, 1)
            log_p = np.where(count > 0, _log10(lower), math.log10(left))
            n_known, base = np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(np.log10((count + 1) / (total + kinds + 1)), starts)
            texts = int(count[sizes.cumsum()[0] - 1])  # as many learned texts begin as end
        else:
            seen = np.empty_like(count)  # how often the history is
            seen[1:] = before[:-1]
            seen[starts] = texts if k == 2 else 0
            asked = np.empty_like(own)
            asked[1:] = want[:-1]
            asked[starts] = True
            p = kept / (seen + EXTRA)
            log_p = np.where(count > 0, _log10(p), log_p)
            on = np.flatnonzero(there & (count == 0) & (seen > 0))
            if len(on):
                by = np.lexsort((history[on], owner[on]))
                doc, h = owner[on][by], history[on][by]
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
                times = np.diff(np.append(cut, len(doc)))
                for i in range(0, len(cut), 100_000):
                    at = cut[i : i + 100_000]
                    yield _scored_rows(kind=["U"] * len(at), uid=np.int64(number) << _DOC_BITS | doc[at], h=h[at].view(np.int64), n=times[i : i + 100_000])
            mine = np.flatnonzero(there)[one[first]]
            mine = mine[asked[mine]]
            if len(mine):
                h, at, of = np.unique(history[mine], return_index=True, return_inverse=True)
                sums = [np.bincount(of, x, len(h)) for x in (count[mine] - kept[mine], lower[mine])]
                held = seen[mine][at]
                cut = list(_slices(h, bits))
                yield _scored_rows(kind=["H"] * len(cut), uid=[_to(x, 0) for x, _ in cut], slice=[x for x, _ in cut], a=[_pack(h[x], True) for _, x in cut], b=[_pack(held[x]) for _, x in cut], c=[_pack_values(sums[0][x]) for _, x in cut], d=[_pack_values(sums[1][x]) for _, x in cut])
            lower = p
        before, want = count, own
    yield _scored_rows(kind=["P"] * n, uid=np.int64(number) << _DOC_BITS | np.arange(n), doc_id=pa.array(ids, mask=null), train=train, n_tokens=sizes, n_known=n_known, base_score=base, score=np.add.reduceat(log_p, starts))


def _weights(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices' sums of histories to (h, alpha), alpha as its logarithm."""
    for group in _groups(it, "slice"):
        h, of = np.unique(np.concatenate([_unpack(r["a"], True) for r in group]), return_inverse=True)
        c = np.zeros(len(h), dtype=np.int64)
        c[of] = np.concatenate([_unpack(r["b"]) for r in group]).astype(np.int64)
        off, taken = (np.bincount(of, np.concatenate([_unpack_values(r[x]) for r in group]), len(h)) for x in ("c", "d"))
        alpha = np.log10((EXTRA + off) / (c + EXTRA)) - np.log10(np.maximum(1 - taken, 1e-12))
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(alpha[i : i + 100_000])], names=["h", "alpha"])


def scores(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    train: the rows to learn from. A null text is empty: its one token is its end. Without
    any training text all words are unknown. Rows that repeat are scored, and counted,
    each; a null doc_id stays null. Columns other than doc_id and text are read by train only.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(2, (parts - 1).bit_length() + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    chunks = _chunks(rows, parts)
    answers = [_counted(chunks, k, bits, parts, k < order) for k in range(1, order + 1)]
    stats = {k: [0] * (K + 3) for k in range(1, order + 1)}
    for k, found in enumerate(answers, 1):
        # one row for each number
        for r in found.where("stats is not null").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            stats[k][r["at"]] = r["n"]

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row,) in _groups(it, "chunk"):
            yield from _chunk_scores(row, stats, bits)

    # answers come to their chunks, which stay where they are
    found = functools.reduce(DataFrame.unionByName, answers).where("chunk is not null")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("order", "slice", "totals", "first", "wanted")).alias("answers"))
    scored = table(chunks.hint("merge").join(found, "chunk", "left").mapInArrow(lean(score), _SCORED))
    spent(chunks, *answers)
    sums = scored.where("kind = 'H'").select("slice", "a", "b", "c", "d", "uid").repartition(parts, "uid").sortWithinPartitions("slice")
    alpha = table(sums.mapInArrow(lean(_weights), "h long, alpha double"))
    more = scored.where("kind = 'U'").select("uid", "h", "n").join(alpha, "h").groupBy("uid").agg(F.sum(F.col("n") * F.col("alpha")).alias("more"))
    out = scored.where("kind = 'P'").select("uid", "doc_id", "train", "n_tokens", "n_known", "base_score", "score").join(more, "uid", "left")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(stats[1][K + 1]).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
