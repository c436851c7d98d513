"""Personal data: fixed patterns as seeds, and identifiers found by bootstrapped contexts.

Matches of the fixed patterns (base spans) are seeds. Whatever else in a text has the
shape of an identifier is a candidate. The words around a seed or candidate make
lexical patterns: two to the left, two to the right, one on either side. In the graph
of patterns and values, a pattern with enough known values (at first the seeds) gives
its values its confidence: of all places in the texts where its words stand, the share
that holds seeds or candidates, not other words. A value's score is that of its best
pattern. Candidates of high score are known from then on, until no more are found; they
are personal data too, of kind ``id``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import batches, bounded, table

#: Base kinds, in the order of results; then the kind of discovered identifiers.
KINDS = ("email", "ip", "card", "phone", "id")
#: A pattern needs so many different known values; a candidate this score.
MIN_SEEDS, MIN_SCORE = 5, 0.6
#: Patterns that tasks get as they are; of more, they get a filter of so many bits.
HELD, FILTER_BITS = 200_000, 1 << 25
#: Patterns that a task counts before it hands them on.
COUNTED = 100_000
#: Characters to either side that are looked at first for context words; more, if they don't hold those whole.
CONTEXT = 80

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Candidates: 6 characters or more, 4 of them digits.
_SHAPE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*")
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&="


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end excluded. Linear in the text."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


def _word(x: str) -> str:
    return x.strip(_EDGES).lower() or x


def _words_before(text: str, end: int) -> list[str]:
    """The last two words of text[:end], fewer if there are no more."""
    size = CONTEXT
    while True:
        found = text[max(0, end - size) : end].split()
        if size >= end or len(found) > 2:  # the first may be cut
            return found[-2:]
        size *= 4


def _words_after(text: str, start: int) -> list[str]:
    """The first two words of text[start:], fewer if there are no more."""
    size = CONTEXT
    while True:
        found = text[start : start + size].split()
        if start + size >= len(text) or len(found) > 2:
            return found[:2]
        size *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span; none where it has no words around it."""
    left = [_word(x) for x in _words_before(text, start)]
    right = [_word(x) for x in _words_after(text, end)]
    found = []
    if len(left) == 2:
        found.append("L " + " ".join(left))
    if len(right) == 2:
        found.append("R " + " ".join(right))
    if left and right:
        found.append(f"B {left[-1]} {right[0]}")
    return found


def _candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in _SHAPE.finditer(text):
        a, b = m.span()
        if b - a < 6 or sum(map(m[0].count, "0123456789")) < 4:
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:  # they come by their start
            yield a, b


_SPAN = "struct<kind:string,start:int,end:int>"
_SEEN = "array<struct<value:string,seed:boolean,start:int,end:int,patterns:array<string>>>"


def _found(docs: DataFrame, keep: bool) -> DataFrame:
    """A table of uid, doc (its id only, if not keep), base and seen (seeds and candidates)."""
    kept = docs.columns if keep else ["doc_id"]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("doc"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        seen_type = pa.list_(pa.struct([("value", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))]))
        for batch in it:
            base, seen = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                mine = [(text[a:b], True, a, b) for _, a, b in found]
                if _DIGIT.search(text):
                    mine += [(text[a:b], False, a, b) for a, b in _candidates(text, found)]
                seen.append([{"value": v, "seed": s, "start": a, "end": b, "patterns": contexts(text, a, b)} for v, s, a, b in mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(seen, seen_type)], names=["doc", "base", "seen"])

    schema = rows.select("doc", F.lit(None).cast(f"array<{_SPAN}>").alias("base"), F.lit(None).cast(_SEEN).alias("seen")).schema
    return table(batches(rows, run, schema).withColumn("uid", F.monotonically_increasing_id()))


def others(text: str, wanted: Callable[[str], bool]) -> Iterator[str]:
    """Those of the patterns around each word of the text that isn't in a seed or candidate, as far as they are wanted."""
    base = base_spans(text)
    held = [(a, b) for _, a, b in base]
    if _DIGIT.search(text):
        held += _candidates(text, base)
    words, free, done = [], [], 0
    for a, b in sorted(held):
        before, own = text[done : max(a, done)].split(), text[max(a, done) : b].split()
        words += before + own
        free += [True] * len(before) + [False] * len(own)
        done = max(done, b)
    rest = text[done:].split()
    words, free = [_word(x) for x in words + rest], free + [True] * len(rest)
    n = len(words)
    pairs = [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
    for k, x in enumerate(pairs):
        if k + 2 < n and free[k + 2] and wanted(one := f"L {x}"):
            yield one
        if k and free[k - 1] and wanted(one := f"R {x}"):
            yield one
    for k, (x, y) in enumerate(zip(words, words[2:], strict=False)):
        if free[k + 1] and wanted(one := f"B {x} {y}"):
            yield one


def _places(pattern: Column) -> list[Column]:
    """Two bits of the filter for a pattern."""
    h = F.crc32(pattern.cast("binary"))
    return [F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h * F.lit(1640531527), 7), F.lit(FILTER_BITS))]


class _Filter:
    """Whether a pattern may be one of those that set the bits."""

    def __init__(self, words: np.ndarray):
        self.bits = words.tobytes()

    def __call__(self, pattern: str) -> bool:
        h = zlib.crc32(pattern.encode())
        a, b = h % FILTER_BITS, h * 1640531527 >> 7
        b %= FILTER_BITS
        return bool(self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1)


def _filter(patterns: DataFrame) -> _Filter:
    """The filter of a table of patterns; what the driver gets is its bits, however many patterns there are."""
    at = patterns.select(F.explode(F.array(*_places(F.col("pattern")))).alias("at"))
    rows = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, dtype="<i8")
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return _Filter(words)


def _others(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n): how often other words stand in the patterns (a table), in one pass over the texts.

    Few patterns are held by each task. Of more, a task lets through what a filter of fixed
    size doesn't rule out; the join with the patterns then drops the rest.
    """
    many = patterns.count() > HELD
    # at most HELD short strings, or FILTER_BITS
    known = _filter(patterns) if many else frozenset(r[0] for r in patterns.collect())
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

        wanted = shared.value if many else shared.value.__contains__
        seen: Counter[str] = Counter()
        for batch in it:
            for text in batch.column(0):
                seen.update(others(text.as_py() or "", wanted))
                if len(seen) >= COUNTED:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    counted = batches(docs.select("text"), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return table(counted.join(patterns, "pattern", "left_semi") if many else counted)


def scores(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, score) of the values that aren't seeds, from edges (a table) of distinct
    (pattern, value, seed, n), n their places; docs has the texts. Values without score
    have none of a pattern with enough known values."""
    kinds = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.count_if(~F.col("seed")).alias("open"), F.sum("n").alias("held"))
    kinds = table(kinds.where((F.col("values") >= MIN_SEEDS) & (F.col("open") > 0)).select("pattern", "held"))
    elsewhere = _others(docs, kinds.select("pattern"))
    sure = table(kinds.join(elsewhere, "pattern", "left").select("pattern", (F.col("held") / (F.col("held") + F.coalesce("n", F.lit(0)))).alias("confidence")))
    edges = table(edges.join(bounded(sure, 64), "pattern").select("pattern", "value", "seed", "confidence"))
    seeds = edges.where("seed").select("value").distinct()
    known, n_known = table(seeds), -1
    while True:
        # patterns of enough known values, seeds or found ones, anew in each round
        strong = table(edges.join(bounded(known, 16), "value", "left_semi").groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS).select("pattern"))
        now = table(edges.where("not seed").join(bounded(strong, 64), "pattern", "left_semi").groupBy("value").agg(F.max("confidence").alias("score")))
        found = now.where(F.col("score") >= MIN_SCORE).select("value")
        n = found.count()
        if n == n_known or not n:
            return now
        known, n_known = table(seeds.unionByName(found).distinct()), n


def spans(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc, base and spans: base spans and all spans of each row of docs.

    Both are by kind, then start: arrays of (kind, start, end), code points, end
    excluded. doc is a struct of the whole row if keep, else of doc_id. Null and empty
    texts have no spans; repeated rows are each judged alone, with values counted once.
    """
    found = _found(docs, keep)
    seen = found.select("uid", F.explode("seen").alias("x")).select("uid", F.xxhash64("x.value").alias("value"), "x.seed", "x.start", "x.end", "x.patterns")
    edges = seen.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    good = table(scores(table(edges), docs).where(F.col("score") >= MIN_SCORE).select("value"))
    more = seen.where("not seed").join(bounded(good, 16), "value", "left_semi")
    more = table(more.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("more")))
    out = found.drop("seen").join(bounded(more, 64, F.size("more") * 48), "uid", "left")
    return out.select("doc", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def joined(of: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, if there, follows the text.

    Spans that overlap are replaced as one, by the kind of the first.
    """
    found = spans(docs, keep=True)
    columns = found.select("doc.*").columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, texts = [], batch.column(0).to_pylist()
            for text, all_spans in zip(texts, batch.column(1).to_pylist(), strict=True):
                if all_spans:
                    parts, done = [], 0
                    for x in sorted(all_spans, key=lambda x: (x["start"], -x["end"])):
                        if x["start"] >= done:
                            parts += [text[done : x["start"]], f"[{x['kind'].upper()}]"]
                        done = max(done, x["end"])
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["text", "doc"])

    rows = batches(found.select(F.col("doc.text").alias("text"), "spans", "doc"), run, found.select(F.col("doc.text").alias("text"), "doc").schema)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("doc.text").isNull(), F.col("doc.n_chars")).otherwise(F.length("text").cast("long"))} if "n_chars" in columns else {"text": F.col("text")}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])
