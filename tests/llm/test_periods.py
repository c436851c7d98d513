"""Runs of repeated words against all pairs of places, by the plain definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from .test_documents import docs, nothing  # noqa: F401

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(w, least=6, power=4):
    """All maximal stretches by their smallest period."""
    found = {}
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, power * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _texts():
    rng = random.Random(11)
    texts = ["", None, " \n\t", "a", "a a a a a", "a a a a a a", "b a a a a a a b", "x " * 3000, "a b " * 4, "a b a b a b a c", "a\tb\na  b a b a b", "é é é é é é", "A a A a A a A a", "A A a a A A a a"]
    for kinds in (1, 2, 2, 2, 3, 5, 40):
        texts += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:kinds] if kinds < 27 else [str(k) for k in range(kinds)]) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    for _ in range(60):  # powers in powers
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 6)
        unit = (unit + [rng.choice("abc")]) * rng.randint(1, 6)
        texts.append(" ".join([rng.choice("abc")] + unit + unit[: rng.randint(0, len(unit))] + [rng.choice("abc")]))
    return texts


def test_extensions():
    from tidemark.llm.periods import Extensions

    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (50, 1), (64, 2), (200, 2), (300, 50)):
        ids = rng.integers(0, kinds, n)
        own = Extensions(ids)
        for a, b in rng.integers(0, n, (200, 2)):
            if a != b:
                want = next((k for k in range(n - max(a, b)) if ids[a + k] != ids[b + k]), n - max(a, b))
                assert own.of(np.array([a]), np.array([b]))[0] == want


@pytest.mark.parametrize("words", [1 << 17, 40])
def test_runs(spark, monkeypatch, words):
    from tidemark.llm import periods

    monkeypatch.setattr(periods, "WORDS", words)
    monkeypatch.setattr(periods, "PAIRS", 64 if words == 40 else periods.PAIRS)
    texts = _texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    plain = {i: SPACE.findall(t or "") for i, t in enumerate(texts)}
    for least, power in ((6, 4), (1, 2)) if words > 40 else ((6, 4),):
        found = periods.repeated_runs(df, least, power).collect()
        assert len(found) == len(texts)
        for r in found:
            w = plain[r.doc.doc_id]
            want = _runs(w, least, power)
            assert (r.n_words, [tuple(x) for x in r.runs]) == (len(w), want), w
            assert r.collapsed == (_collapsed(w, want) if want else None)
    kept = periods.collapsed(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: _collapsed(plain[i], x) if (x := _runs(plain[i])) else t for i, t in enumerate(texts)}


def test_odd_rows(docs, nothing):  # noqa: F811
    from tidemark.llm.periods import repeated_runs

    assert repeated_runs(nothing).count() == 0
    found = repeated_runs(docs).collect()
    assert len(found) == docs.count() and all([tuple(x) for x in r.runs] == _runs(SPACE.findall(r.doc.text or "")) for r in found if len(r.doc.text or "") < 20_000)
    assert [(x.start, x.length, x.period) for r in found if (r.doc.text or "").startswith("x x x") for x in r.runs] == [(0, 20_000, 1)]


def test_query(spark, tmp_path):
    """The whole query on odd documents and those of the smallest table."""
    from tidemark.llm.queries import op11_periodic_runs

    rows = [(i, t) for i, t in enumerate(_texts())] + [(1, "twice"), (None, "a a a a a a a")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 6000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = _runs(w)
        best = min(((-n, s, p) for s, n, p in runs), default=None)
        row = (i, len(runs)) + ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        want.append(row + (hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(_collapsed(w, runs).encode()).hexdigest()))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(r[1] > 0 for r in want if (r[0] or 0) >= 1000) > 5
