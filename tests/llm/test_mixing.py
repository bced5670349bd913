from collections import Counter

from lexatlas.llm import mixing as m

from tests.llm.conftest import words


def waterfill(sizes, weights, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
        free -= over


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 3, "e": 70}
    got = {r["source"]: r["target"] for r in m.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = waterfill(sizes, (5, 2, 1))
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_plan_and_mix(odd, none):
    plan = m.mix_plan(odd).collect()
    assert len(plan) == odd.count() and m.mix_plan(none).count() == 0 and m.mix(none).count() == 0
    size = Counter()
    for r in odd.collect():
        size[r["source"]] += len(words(r["text"]))
    assert all(r["source_size"] == size[r["source"]] and r["copies"] <= 3 for r in plan)
    want = waterfill(dict(size), (5, 2, 1))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in plan)
    mixed = m.mix(odd)
    assert mixed.count() == sum(r["copies"] for r in plan) and mixed.count() == m.mix(odd).count()
    assert set(mixed.columns) == set(odd.columns)


def test_near_target(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 7 as int)) as text", "if(id % 3 = 0, 'x', 'y') as source")
    rows = m.mix_plan(docs).collect()
    for s in "xy":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) / own[0]["target"] - 1) < 0.05
