import random

import pytest
from pyspark.sql import functions as F

from lexatlas.functions import lexical
from lexatlas.operators import term_index


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["hot", *[f"w{i}" for i in range(40)]]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 20))) + " hot") for i in range(2000)]
    # a few rows far above the others, all in one range
    docs += [(i, "rare rare hot " * 30) for i in range(2000, 2030)]
    frame = spark.createDataFrame(docs, "id long, text string").repartition(5)
    post = lexical.postings(frame, stop=[])
    return docs, post, term_index.build(post, str(tmp_path_factory.mktemp("terms") / "t"), span=100, files=6)


def rows(df):
    return [(r["key"], round(r["score"], 6)) for r in df.collect()]


@pytest.mark.parametrize("words", [["hot"], ["rare", "hot"], ["w1", "w2", "w1"], ["nothing"], ["w3", "nothing"]])
def test_any_of_is_exact(indexed, words):
    docs, post, index = indexed
    for k in (5, 40):
        full = post.where(F.col("term").isin(words)).groupBy("key").agg((F.sum(F.size("places")) * 0.1).alias("score")).orderBy(F.col("score").desc(), "key").limit(k)
        assert rows(index.any_of(words, k)) == rows(full)


def test_ranges_that_cannot_win_are_left_out(indexed, monkeypatch):
    _, _, index = indexed
    monkeypatch.setattr(term_index, "FIRST", 1)
    bounds = {r["range"]: r["b"] for r in index.maxima.where("term in ('rare', 'hot')").groupBy("range").agg(F.sum("best").alias("b")).collect()}
    got = rows(index.any_of(["rare", "hot"], 20))
    assert {k // 100 for k, _ in got} == {20} and len(bounds) == 21
    assert sum(b >= 10 * got[-1][1] for b in bounds.values()) == 1
    plan = index.of(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,w1)" in plan.replace("In(term, [w1])", "EqualTo(term,w1)")


def test_clustered(spark, indexed):
    """Each file holds a range of terms, so that one term's rows are in few of them, and a hot one's in several."""
    _, _, index = indexed
    spans = index.rows.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("low", "high").collect()
    assert len(spans) > 1 and all(a["high"] <= b["low"] for a, b in zip(spans, spans[1:], strict=False))
    assert index.rows.where("term = 'w7'").select(F.input_file_name()).distinct().count() <= 2


def test_all_of_and_stems(spark, indexed, tmp_path):
    docs, post, index = indexed
    q = lexical.parse("w1 w2 -w3")
    assert sorted(rows(index.all_of(q))) == sorted(rows(lexical.matching(post, q)))
    words = {"walked": "walk", "walking": "walk", "walks": "walk", "running": "run", "classes": "class", "ponies": "poni", "pony": "poni", "need": "need", "seeing": "see", "gas": "gas", "bus": "bus", "widely": "wid", "wide": "wid", "1004.5": "1004.5", "été": "été", "doors": "door"}
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", term_index.stem(F.col("w")).alias("s")).collect()}
    assert got == words
    texts = spark.createDataFrame([(1, "Doors opening and a door"), (2, "open the doors"), (3, "window")], "id long, text string")
    stems = term_index.build(lexical.postings(texts), str(tmp_path / "s"), stems=True)
    assert {k for k, _ in rows(stems.all_of(lexical.parse("door opened")))} == {1, 2}
    assert rows(stems.any_of(["doors"], 5)) == [(1, 0.2), (2, 0.1)]
    assert {r["key"]: r["places"] for r in stems.of(["door"]).collect()} == {1: [0, 4], 2: [2]}
    assert stems.any_of([], 5).count() == 0


def test_lexical_top_is_matches_without_pairs(spark):
    """The same as by pairs in all modes: rows of one key, null keys and texts, ties, more rows than k; and no pair is dealt."""
    import random

    from lexatlas.operators import batch

    rng = random.Random(3)
    rows = [(i if i % 9 else None if i % 2 else 90, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "zz"), (4, "a"), (4, "zz")], "question long, term string")
    got = batch.lexical_top(docs, asked, 7, ("strict", "any", "both"), stop=[]).collect()
    by_pairs = batch.matches(batch.places(docs, asked, stop=[]), asked)
    for mode in ("strict", "any", "both"):
        want = {tuple(r) for r in batch.lexical_best(by_pairs, 7, mode).collect()}
        assert {tuple(r)[1:] for r in got if r["mode"] == mode} == want, mode
    assert batch.lexical_top(docs, asked.limit(0), 7, stop=[]).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_postings_within_rows(spark):
    """The places of each term as the dealt postings have them; nothing is dealt."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["a1", "b", "the", "été", "zz"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "the"), (63, "x x x")]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = frame.select(F.col("id").alias("key"), F.inline(lexical.gathered(lexical.terms(F.col("text")))))
    as_set = lambda df: sorted((r["term"], r["key"], tuple(r["places"])) for r in df.select("term", "key", "places").collect())
    assert as_set(got) == as_set(lexical.postings(frame)) and ("x", 63, (0, 1, 2)) in as_set(got)
    assert exchanges(got) == 0


def test_stems_are_dealt_once(spark):
    rows = spark.createDataFrame([("doors", 1, [0]), ("door", 1, [4]), ("door", 2, [1]), ("open", 1, [2])], "term string, key long, places array<int>")
    made = term_index.stemmed(rows)
    assert sorted((r["term"], r["key"], r["places"]) for r in made.collect()) == [("door", 1, [0, 4]), ("door", 2, [1]), ("open", 1, [2])]
    assert exchanges(made) == 1


def test_repeated_ids_are_one_row(spark, tmp_path):
    """Rows of one id share their postings and windows, as SQL counts them."""
    from lexatlas.plans import workload

    spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["term"], r["key"]): r["places"] for r in workload.index_of(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): [0, 2], ("b", 1): [0, 1], ("c", 1): [1], ("a", 2): [0]}
    assert sorted(map(tuple, workload.naive_windows(spark, str(tmp_path)).collect())) == [(1, 0, 5), (2, 0, 1)]


def test_maxima_are_dealt_once(spark, indexed, tmp_path):
    _, post, index = indexed
    want = post.groupBy("term", F.floor(F.col("key") / 100).alias("range")).agg(F.max(F.size("places")).alias("best"), F.count("*").alias("rows"))
    as_set = lambda df: sorted(map(tuple, df.select("term", "range", "best", "rows").collect()))
    assert as_set(index.maxima) == as_set(want)
