"""The learner of toxicity and the verdict on quality against plain computations."""

import collections
import math
import random
import re
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _ftrl(rows, alpha, beta, l1, l2, epochs):
    """Coordinate by coordinate, as in McMahan and others, "Ad Click Prediction" (2013), algorithm 1; the bias has no L1."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        lam = 0.0 if i == "bias" else l1
        if abs(z[i]) <= lam and i != "bias":
            return 0.0
        sign = (z[i] > 0) - (z[i] < 0)
        return -(z[i] - sign * lam) / ((beta + math.sqrt(n[i])) / alpha + (0.0 if i == "bias" else l2))

    for _ in range(epochs):
        for x, y in rows:
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = p - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: w for i in z if i != "bias" and (w := weight(i))}, weight("bias")


def test_ftrl():
    from tidemark.llm import toxicity as T

    rng = random.Random(2)
    rows = []
    for _ in range(300):
        y = rng.randrange(2)
        rows.append((sorted({rng.randrange(20) + 20 * (y if rng.random() < 0.8 else 1 - y) for _ in range(rng.randint(0, 8))}), y))
    at, w, bias = T.learn([(np.array(x, dtype=np.int32), y) for x, y in rows])
    want, b = _ftrl(rows, T.ALPHA, T.BETA, T.L1, T.L2, T.EPOCHS)
    assert set(at.tolist()) == set(want) and len(want) < 40 and math.isclose(bias, b, rel_tol=1e-9)
    assert all(math.isclose(x, want[i], rel_tol=1e-9) for i, x in zip(at.tolist(), w.tolist(), strict=True))


def test_rows_not_held(spark, monkeypatch):
    """The learner can go through all rows again and again, but they aren't in memory together."""
    import weakref

    from pyspark.sql import functions as F

    from tidemark.llm import toxicity as T

    def learn(rows):
        seen = [(weakref.ref(x), x.tolist(), y) for x, y in rows]
        again = [(x.tolist(), y) for x, y in rows]
        held = sum(ref() is not None for ref, _, _ in seen)
        return np.array([held, len(again), sum(not x for x, _ in again)]), np.zeros(3), float([x[1:] for x in seen] == again)

    monkeypatch.setattr(T, "learn", learn)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat_ws(" ", F.sequence(F.lit(1), F.col("id")))).alias("text"))
    got = T.model(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert got[0] == (-1, 1.0)
    assert got[1][0] <= 1 and got[2][0] == len(train) and got[3][0] == sum(i % 7 == 0 for i in train)


def _distance(p, q):
    """Jensen-Shannon distance by entropies."""
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    entropy = lambda v: -sum(x * math.log2(x) for x in v if x)
    return math.sqrt(max(0.0, entropy([(a + b) / 2 for a, b in zip(p, q, strict=True)]) - (entropy(p) + entropy(q)) / 2))


def test_verdicts(spark):
    """Distances and verdicts of texts of several languages and of junk."""
    from tidemark.llm import quality as Q

    rng, rows = random.Random(5), []
    for i in range(240):
        lang = rng.choice(["en", "de", "fr", "xx", None])
        common, kind = Q.COMMON_WORDS.get(lang, ["a"]), rng.random()
        word = lambda c=common, k=kind: (rng.choice(c) if rng.random() < (0.25 if k < 0.7 else 0.0) else "".join(rng.choice("etaoinshrdlu" if k < 0.85 else "XQ#%9$@") for _ in range(rng.randint(3, 8)))) + rng.choice(["", "", "", ".", ","])
        rows.append((i, " ".join(word() for _ in range(rng.choice([0, 5, 60, 120, 300]))), lang))
    classes = [re.compile(f"[{c}]") for c in Q.CLASSES.values()]
    plain, sums = {}, {}
    for i, text, lang in rows:
        w = SPACE.findall(text)
        times = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if times[x] > 1 for d in range(3)}
        base_failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        chars = [len(c.findall(text)) for c in classes]
        low = collections.Counter(x.lower() for x in w)
        hits = [low[x] for x in Q.COMMON_WORDS[lang]] if lang in Q.COMMON_WORDS else None
        plain[i] = (base_failed, len(w), [*chars, len(text) - sum(chars)], hits and [*hits, len(w) - sum(hits)], lang, len(text))
        if lang in Q.COMMON_WORDS and not base_failed:
            a, b = sums.setdefault(lang, ([0] * 7, [0] * 17))
            sums[lang] = [x + y for x, y in zip(a, plain[i][2], strict=True)], [x + y for x, y in zip(b, plain[i][3], strict=True)]
    found = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    kept = collections.Counter()
    for i, (base_failed, n, chars, hits, lang, size) in plain.items():
        by_class = _distance(chars, sums[lang][0]) if lang in sums else min(_distance(chars, s[0]) for s in sums.values())
        by_word = _distance(hits, sums[lang][1]) if lang in sums else 0.0
        fewer = False
        if lang in sums:
            own = sums[lang][1]
            expected = n * sum(own[:-1]) / sum(own)
            absent = _distance([0] * 16 + [1], own)
            fewer = expected >= Q.MIN_EXPECTED and n - hits[-1] < expected and by_word > absent * Q.MAX_ABSENCE
        bad = (size >= Q.MIN_CHARS and by_class > Q.MAX_CLASS_DISTANCE) or (n >= Q.MIN_WORDS and (by_word > Q.MAX_WORD_DISTANCE or fewer))
        r = found[i]
        assert math.isclose(r.class_distance, by_class, abs_tol=1e-7) and math.isclose(r.word_distance, by_word, abs_tol=1e-7)
        assert (r.base_failed, r.kept) == (base_failed, not base_failed and not bad)
        kept[(base_failed, bad)] += 1
    assert min(kept[(False, False)], kept[(False, True)]) > 20
