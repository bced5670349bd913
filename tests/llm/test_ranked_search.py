import math
import random
import re
from collections import Counter, defaultdict

import numpy as np


from lexatlas.llm import queries
from lexatlas.llm import ranked_search as r

from tests.llm.conftest import LOW


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, top):
    """{(item, text): [(rank, doc, score)]} by the formula, document by document."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total, df = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags), Counter()
    for _, b in bags:
        df.update(b.keys())
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scores = []
        for d, b in bags:
            n = sum(b.values())
            s = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 20 * (50 + 50 * n * n_docs // total))) for t in w if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark, odd, none):
    items = [(1, "w1 W2 w3, w3"), (2, None), (3, ""), (4, "nothing-here"), (None, "Ünï ok"), (1, "w7 zz"), (1, "w7 zz")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for top in (3, 50):
        got = held(r.search(odd, asked, top=top))
        assert got == brute([(d["doc_id"], d["text"]) for d in odd.collect()], items, top) and got
    assert r.search(none, asked).count() == 0 and r.search(odd, asked.limit(0)).count() == 0


def test_copies_ties_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(vocab[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    hot = text(40)
    docs = [(i, hot if i % 3 == 0 else text(rng.choice([1, 5, 30, 200]))) for i in range(900)] + [(i, f"{hot} more") for i in range(100)]
    items = [(i, text(12)) for i in range(6)] + [(6, hot)]
    monkeypatch.setattr(r, "TOGETHER", 3)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = r.build(frame, most=64, postings=4000)
    assert index.forward.select("block").distinct().count() > 8
    assert held(r.search(frame, asked, index, top=20)) == brute(docs, items, 20)
    # the index can be asked again, and broadcasts can be left out
    monkeypatch.setattr(r, "SMALL", 0)
    assert held(r.search(frame, asked, index, top=5)) == brute(docs, items, 5)


def test_bounds_hold_and_leave_documents_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    index = r.build(docs)
    lists = index.lists.collect()
    exact = {(f["block"], f["at"], t): (f["n"], c) for f in index.forward.collect() for t, c in zip(f["terms"], f["tfs"], strict=True)}
    seen = 0
    for row in lists:
        for at, b in zip(np.frombuffer(row["places"], np.int32), row["impacts"], strict=True):
            n, tf = exact[row["block"], int(at), row["term"]]
            f = 10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * index.documents // index.tokens))
            assert (b - 1) * r.STEP < f <= b * r.STEP
            seen += 1
    assert seen == len(exact)
    first = lists[0]["term"]
    asked = spark.createDataFrame([(0, first, 1000), (0, "and", 500)], "q long, term string, w long")
    some = r.candidates(index, asked, 5).collect()
    counts = defaultdict(int)
    for block, at, term in exact:
        counts[block, at] += term in (first, "and")
    assert 5 <= len(some) < len([c for c in counts.values() if c])


def test_query(spark):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(i["item_id"], i["text"]) for i in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert held(queries.op12_ranked_search(spark, "/root/testdata/sf0.001")) == brute(docs, items, 50)
