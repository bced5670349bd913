import random

from lexatlas.llm import decontamination as dc

from tests.llm.conftest import words


def local(item, passage):
    """Smith-Waterman by the book."""
    best, prev = 0, [0] * (len(passage) + 1)
    for x in item:
        cur = [0]
        for j, y in enumerate(passage, 1):
            cur.append(max(0, prev[j - 1] + (dc.MATCH if x == y else dc.DIFFER), prev[j] + dc.GAP, cur[-1] + dc.GAP))
        best, prev = max(best, *cur), cur
    return best


def test_alignment():
    import numpy as np

    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, s, e = dc.align(np.array(a), np.array(b))
        assert score == local(a, b) and 0 <= s <= e <= len(b)


def tables(spark):
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [prose(25) for _ in range(6)]
    docs = []
    for i in range(120):
        w = prose(rng.randrange(10, 200))
        if i % 4 == 0:
            own = list(items[i % 6])
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(own))
                what = rng.randrange(3)
                own[at : at + 1] = [[rng.choice(vocab)], [], [own[at], rng.choice(vocab)]][what]
            at = rng.randrange(len(w))
            w[at:at] = own
        docs.append((i, " ".join(w).upper() if i % 8 == 0 else ", ".join(w)))
    docs += [(200, None), (201, ""), (None, " ".join(items[0])), (3, " ".join(items[1]))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "t1 t2")], "item_id long, text string"), docs, items


def test_against_brute_force(spark):
    docs, items, rows, texts = tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect() if r["item_id"] < 90}
    want = set()
    for d, t in rows:
        w = words((t or "").replace(",", ""), True)
        want |= {(d, i) for i, item in enumerate(texts) if local(item, w) >= dc.COPY * dc.MATCH * len(item)}
    assert got == want


def test_rows_and_columns_stay(spark, odd, none):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = dc.decontaminated(odd, items)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in odd.join(out, "doc_id", "left_anti").where("doc_id is not null").collect()) == [6, 7]
    assert dc.decontaminated(none, items).count() == 0 and dc.decontaminated(odd, items.limit(0)).count() == odd.count()


def test_slices_of_the_benchmark(spark, monkeypatch):
    docs, items, _, _ = tables(spark)
    whole = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()}
    monkeypatch.setattr(dc, "SLICE", 40)
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()} == whole
