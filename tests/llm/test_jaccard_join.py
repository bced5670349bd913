import random
from itertools import combinations

import pytest

from lexatlas.llm import jaccard_join as jj
from lexatlas.llm.components import components

from tests.llm.conftest import words


def brute(rows, n, percent):
    sets = []
    for r in rows:
        w = words(r["text"], True)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], len(sets[i]), least.get(find(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows)]


def check(df, n, percent):
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, n, percent).collect()), key=key)
    assert got == sorted(brute(df.collect(), n, percent), key=key)


def test_odd_rows(odd, none):
    check(odd, 4, 85)
    assert jj.jaccard_components(none, 4, 85).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (1, 80)])
def test_groups(spark, n, percent):
    """Chains of near copies, short texts on both sides of the boundary, and shared passages."""
    rng = random.Random(n)
    vocab = [f"v{i}" for i in range(200)]
    rows = []
    for size in (6, 9, 12, 14, 20, 40, 150):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w.append(rng.choice(vocab))
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(rng.choice(vocab) for _ in range(30))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choice(vocab) for _ in range(40))) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)


@pytest.mark.parametrize(("n", "percent", "light", "size"), [(4, 85, 7, 10), (4, 85, 10, 10), (1, 80, 5, 5)])
def test_light_sets_below_the_threshold(spark, monkeypatch, n, percent, light, size):
    """Texts that differ in one word, at a boundary that makes them light: sets of the larger size of a key aren't linked by it."""
    monkeypatch.setattr(jj, "boundary", lambda sizes, percent: light)
    rng = random.Random(light)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = rng.sample(vocab, size)
        for at in (0, 1, size // 2, size - 1, size - 1):
            w = list(base)
            w[at] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows), " ".join(base))]
        if rng.random() < 0.5:
            rows += [(len(rows), " ".join(base[:-1])), (len(rows) + 1, " ".join([*base, "more"]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)


def test_hot_text_is_dealt_over_blocks(spark, monkeypatch):
    """A text that fills several blocks lies in several; components are the same."""
    monkeypatch.setattr(jj, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    hot = " ".join(rng.choice("abcdefghij") + str(i) for i in range(40))
    rows = [(i, hot) for i in range(400)] + [(1000 + i, hot + " more" if i % 3 else "alone " + str(i) + " of many texts here") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = jj._spread(df.selectExpr("doc_id key", "text t"), 8).where(f"t = '{hot}'")
    sizes = [r["count"] for r in dealt.groupBy("deal").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 60 and sum(sizes) == 400
    check(df, 4, 85)


def test_boundary_is_by_cost():
    assert jj.boundary({a: 100 for a in range(1, 6)}, 85) == 5 and jj.boundary({}, 85) == 0
    assert jj.boundary({30: 100, 12: 1}, 50) == 0
    assert all(jj.need(a, a, 85) <= a for a in range(1, 50))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rng.randrange(1, 30)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(v == 100 for k, v in got.items() if k >= 100)
