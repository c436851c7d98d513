"""The join by token groups against all pairs of sets."""

import random

import pytest

from .test_documents import _components, _shingles, _texts, docs, nothing  # noqa: F401


@pytest.mark.parametrize("percent", [80, 60, 100])
def test_join(docs, nothing, percent):  # noqa: F811
    from tidemark.llm.groups import joined

    assert joined(nothing).count() == 0
    want, sizes = _components(dict(enumerate(_texts())), percent)
    found = joined(docs, percent / 100).collect()
    assert len(found) == docs.count() and {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.n_shingles == sizes[r.doc_id] for r in found if r.doc_id is not None) and [r.component_id for r in found if r.doc_id is None] == [None]


def _copies(rng, n, words):
    """Copies of a few texts with words changed, dropped and put in, around the similarity, and texts that share a passage."""
    base = [[str(rng.randrange(10**6)) for _ in range(words)] for _ in range(4)]
    passage, out = [str(rng.randrange(10**6)) for _ in range(words // 2)], []
    for k in range(n):
        w = list(base[k % 4])
        for _ in range(rng.randrange(0, words // 25 + 2)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [str(rng.randrange(10**6))], [w[i], "in"]])
        out.append(" ".join(w))
    out += [" ".join(passage + [str(rng.randrange(10**6)) for _ in range(words // 8 + rng.randrange(words // 2))]) for _ in range(n // 2)]
    return out + out[: n // 4]


@pytest.mark.parametrize(("group", "rounds", "first"), [(64, 6, 8), (5, 2, 1)])
def test_copies(spark, monkeypatch, group, rounds, first):
    """Chains of copies: exactly the components of all links, with small groups and few rounds too, where the last step does the work."""
    from tidemark.llm import groups

    for k, v in (("GROUP", group), ("ROUNDS", rounds), ("FIRST", first), ("GROUP_SHINGLES", 1 << 17 if group > 5 else 300)):
        monkeypatch.setattr(groups, k, v)
    texts = dict(enumerate(_copies(random.Random(group), 160, 60)))
    want, _ = _components(texts, 80)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in groups.joined(df).collect()} == want
    assert 4 < len(set(want.values())) < len(want)


def test_each_link(spark):
    """Pairs alone, of all sizes, just at, below and above the limit."""
    from tidemark.llm.groups import joined

    rng, texts = random.Random(9), []
    for n in (1, 4, 5, 6, 9, 12, 20, 33, 50, 90, 140):
        for cut in range(0, n // 3 + 1, max(1, n // 12)):
            w = [str(rng.randrange(10**9)) for _ in range(n)]
            texts += [" ".join(w), " ".join(w[: n - cut]), " ".join(w[:n // 2] + ["x"] * cut + w[n // 2 :])]
    texts = dict(enumerate(texts))
    want, _ = _components(texts, 80)
    found = {r.doc_id: r.component_id for r in joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == want and any(100 * len(_shingles(texts[a]) & _shingles(texts[b])) == 80 * len(_shingles(texts[a]) | _shingles(texts[b])) for a, b in want.items() if a != b)


def test_repeated_ids(spark):
    """Rows of one id with different texts bring their components together."""
    from tidemark.llm.groups import joined

    rng = random.Random(2)
    w = [[str(rng.randrange(10**6)) for _ in range(40)] for _ in range(3)]
    a, b, c = (" ".join(x) for x in w)
    rows = [(7, a), (7, b), (9, a + " end"), (8, b + " end"), (5, c), (6, c + " end"), (6, c + " end"), (1, "other words here")]
    found = joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (5, 5), (6, 5), (6, 5), (7, 7), (7, 7), (8, 7), (9, 7)]
