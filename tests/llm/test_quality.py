import random

import numpy as np

from lexatlas.llm import quality as q


def corpus(spark, n=600):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(30, 120))]
        toxic, bad = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for x in ("grobian", "idiot", "lumpenhund")[: rng.randrange(1, 4)]:
                w.insert(rng.randrange(len(w)), x)
        t = " ".join(w)
        if bad:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(x + "###" for x in w), " | ".join(w), " ".join([w[0]] * 50)])
        rows.append((i, t))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    truth = {i: (int(not any(c in t for c in ("!!", "###", " | ")) and len(set(t.split())) > 1), int(any(x in t.lower() for x in ("grobian", "idiot", "lumpenhund")))) for i, t in rows}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = q.classify(docs, q.train(docs, labels)).where("doc_id % 2 = 1").collect()
    assert np.mean([(r["p_quality"] >= 0.5) == truth[r["doc_id"]][0] for r in got]) > 0.97
    assert np.mean([(r["p_toxic"] >= 0.5) == truth[r["doc_id"]][1] for r in got]) > 0.9


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    n = 20000
    y = rng.random(n) < 0.7
    fires = np.stack([np.where(y, rng.random(n) < 0.01, rng.random(n) < p) for p in (0.6, 0.3)], 1)
    said = np.where(rng.random(n) < 0.3, np.where(y, 1, -1), 0)
    patterns, counts = np.unique(np.concatenate([-fires.astype(int), said[:, None]], 1), axis=0, return_counts=True)
    _, w = q.accuracies(patterns, counts.astype(float), 2, 0.8)
    assert abs(w[0, 0] - np.log(0.01 / 0.6)) < 1.5 and abs(w[1, 0] - np.log(0.01 / 0.3)) < 1.5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = q.train(odd, labels)
    out = q.classify(odd, model)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns) | {"p_quality", "p_toxic"}
    assert q.classify(none, q.train(none, labels.limit(0))).count() == 0


def test_labellers_count_with_many_labels(spark, monkeypatch):
    """With more than an eighth of the sample labelled, what the labellers' weights say still reaches the scores."""
    docs, labels, _ = corpus(spark)
    assert labels.count() > 400 / 8
    scores = lambda: {r["doc_id"]: (r["p_quality"], r["p_toxic"]) for r in q.classify(docs, q.train(docs, labels, sample=400)).collect()}
    found = scores()
    estimated = q.accuracies
    monkeypatch.setattr(q, "accuracies", lambda *a: (0.0, np.zeros_like(estimated(*a)[1])))
    silent = scores()
    assert max(abs(found[i][0] - silent[i][0]) for i in found) > 0.01 and max(abs(found[i][1] - silent[i][1]) for i in found) > 0.01


def test_spoilt_accuracies_change_scores_with_thousands_of_labels(spark, monkeypatch):
    """Labels are one labeller among others at every size: what EM finds of the others reaches all scores."""
    docs, labels, _ = corpus(spark, 9000)
    assert labels.count() > 4000
    scores = lambda: {r["doc_id"]: (r["p_quality"], r["p_toxic"]) for r in q.classify(docs, q.train(docs, labels, sample=3000)).collect()}
    found, estimated = scores(), q.accuracies

    def spoilt(*a):
        prior, w = estimated(*a)
        w[:-1] *= -1
        return prior, w

    monkeypatch.setattr(q, "accuracies", spoilt)
    other = scores()
    assert all(np.mean([abs(found[i][k] - other[i][k]) for i in found]) > 0.01 for k in (0, 1))


def test_em_against_a_plain_form():
    """The table of patterns gives the same weights as an expectation-maximisation that walks single documents."""
    rng = np.random.default_rng(4)
    votes = np.stack([-(rng.random(400) < 0.2).astype(int), -(rng.random(400) < 0.3).astype(int), rng.choice([-1, 0, 1], 400)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, w = q.accuracies(patterns, counts.astype(float), 2, 0.8, rounds=6)
    sure = np.log(q.TRUST / (1 - q.TRUST))
    weights = {0: (-4.0, 0.0, 4.0), 1: (-4.0, 0.0, 4.0), 2: (-sure, 0.0, sure)}
    odds = np.log(0.8 / 0.2)
    for turn in range(6):
        p = [1 / (1 + np.exp(-np.clip(v[2] * sure if v[2] else odds + sum(weights[j][v[j] + 1] for j in range(3)), -30, 30))) for v in votes]
        use = [1.0 if turn or v[2] else 0.0 for v in votes]
        for j in (0, 1):
            x, y = ([sum(u * (t if good else 1 - t) for v, t, u in zip(votes, p, use) if v[j] == k) + 0.5 for k in (-1, 0, 1)] for good in (True, False))
            ratio = [np.log(a / sum(x)) - np.log(b / sum(y)) for a, b in zip(x, y)]
            weights[j] = min(ratio[0], -0.5), 0.0, max(ratio[2], 0.5)
        good = sum(u * t for t, u in zip(p, use))
        odds = np.log((good + 1) / (sum(use) - good + 1))
    assert abs(prior - odds) < 1e-9 and np.allclose(w, [weights[j] for j in range(3)])
