import math
import zlib
from collections import Counter

from lexatlas.llm import lm_scoring as lm

from tests.llm.conftest import words


def brute(rows, order=3):
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    toks = [[*words(r["text"], True), None] for r in rows]
    uni, bi = Counter(), Counter()
    for t, h in zip(toks, held, strict=True):
        if not h:
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t, strict=True))
    tri, into = Counter(), Counter()
    for t, h in zip(toks, held, strict=True):
        for u, x, w in zip([None, *t], t, t[1:]) if not h else ():
            if bi[u, x] > 1 and bi[x, w] > 1:
                tri[u, x, w] += 1
                into[u, x] += 1
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = once / (once + 2 * twice) if once else 0.5
    p = lambda w: (uni[w] - d) / n if uni[w] else d * v / n
    out = []
    for t, h in zip(toks, held, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        two = lambda a, w: (bi[a, w] + lm.PRIOR * p(w)) / (uni[a] + lm.PRIOR)
        score = math.log10(two(None, t[0]))
        for u, x, w in zip([None, *t], t, t[1:]):
            m = lm.PRIOR_TWO
            score += math.log10((tri[u, x, w] + m * two(x, w)) / (into[u, x] + m) if order > 2 and into[u, x] else two(x, w))
        out.append((h, len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


def test_against_brute_force(odd, none):
    rows = odd.collect()
    for order in (3, 2):
        got = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(odd, order=order).collect())
        want = brute(rows, order)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert all(abs(x - y) < 1e-4 for g, w in zip(got, want, strict=True) for x, y in zip(g[4:], w[4:], strict=True))
    assert lm.score(none).count() == 0


def test_a_distribution(spark):
    """After any context the probabilities of all known words, the end and the unknown word sum to one, as differences of scores."""
    texts = ["a b a c", "a b b", "a b a c a b", "c a b a"]
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 7 != 2]
    out = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    starts, asked = ["", "a", "a b", "b a", "c a b", "zz", "a zz", "b b"], []
    for x in starts:
        asked += [x, *[f"{x} {w}".strip() for w in ("a", "b", "c", "zz")], f"{x} stop"]
    docs = spark.createDataFrame([*zip(ids, texts), *zip(out, asked)], "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score(docs).where("held_out").collect()}
    p = [got[i] for i in out[: len(asked)]]
    # P(x), whole text, is P(prefix) * P(end | prefix): the end's share and the words' shares of a prefix add up once the end is divided out
    ends = {x: q for x, q in zip(asked, p)}
    b = brute_model(texts)
    for x in starts:
        words_ = x.split()
        prefix = math.prod(b(words_[:k], w) for k, w in enumerate(words_))
        assert abs(ends[x] / prefix - b(words_, None)) < 1e-6
        assert abs(sum(b(words_, w) for w in ("a", "b", "c", None)) + b(words_, "zz") - 1) < 1e-9


def brute_model(texts):
    """P(word | words before) of the model of these texts; all unseen words share one unknown word's probability."""
    toks = [[*t.split(), None] for t in texts]
    uni, bi, tri, into = Counter(), Counter(), Counter(), Counter()
    for t in toks:
        uni.update(t)
        bi.update(zip([None, *t[:-1]], t, strict=True))
    for t in toks:
        for u, x, w in zip([None, *t], t, t[1:]):
            if bi[u, x] > 1 and bi[x, w] > 1:
                tri[u, x, w] += 1
                into[u, x] += 1
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = once / (once + 2 * twice) if once else 0.5

    def p(before, w):
        c = [None, *before]
        one = (uni[w] - d) / n if uni[w] else d * v / n
        two = (bi[c[-1], w] + lm.PRIOR * one) / (uni[c[-1]] + lm.PRIOR)
        if len(c) < 2 or not into[c[-2], c[-1]]:
            return two
        return (tri[c[-2], c[-1], w] + lm.PRIOR_TWO * two) / (into[c[-2], c[-1]] + lm.PRIOR_TWO)

    return p


def test_what_stands_twice_scores_apart(spark):
    """A text that the training texts have twice is far likelier than one of the same words in another order."""
    import random

    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(60))) for i in ids]
    rows[7] = (rows[7][0], rows[3][1])
    mixed = rows[3][1].split()
    rng.shuffle(mixed)
    rows[9] = (rows[9][0], " ".join(mixed))
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[rows[3][0]] > got[rows[9][0]] + 0.05


def test_memory_of_a_block():
    """What a task holds of a block: the arrays of 200,000 tokens, all of whose pairs are contexts, stay within bytes a token."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 1_000)) for _ in range(200)]
    own = pa.table({"key": list(range(200)), "t": texts, "out": [False] * 200, "block": [0] * 200})
    none = pa.table({"part": pa.array([], pa.int64()), "places": pa.array([], pa.binary()), "totals": pa.array([], pa.binary())})
    lm.block_of(own, none, 4)  # the hashes' tables of powers stay
    tracemalloc.start()
    try:
        b = lm.block_of(own, none, 4)
        tokens = len(b.word)
        assert tracemalloc.get_traced_memory()[1] < 105 * tokens
        b.pair_counts = np.maximum(b.pair_counts, lm.LEAST)
        tracemalloc.reset_peak()
        found = lm.triples_of(b, none, 4)
        m, arcs = lm.automaton(b, found, tokens, len(b.words), 0.5, lm.PRIOR, lm.PRIOR_TWO)
        got = m.traverse(b.word, b.pair, arcs, b.firsts, int(m.word_next[b.begin]))
        assert tracemalloc.get_traced_memory()[1] < 190 * tokens
        assert (got < 0).all()
    finally:
        tracemalloc.stop()
