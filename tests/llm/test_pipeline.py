import random

import corpus_pipeline as cp
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"s{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(20)
    long = prose(200)
    rows = [(i, prose(60) + ".\n" + prose(30), "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(40, prose(30) + " " + item + " " + prose(30), "en", "src0", 0), (41, long, "en", "src1", 0), (42, long + " extra", "en", "src1", 0), (43, None, "en", None, None), (44, "", None, "src2", 0), (45, rows[3][1], "en", "src1", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(40)) <= ids and not {40, 42, 45} & ids and 41 in ids
    mixed = cp.STAGES[-1][1](spark, kept, str(tmp_path))
    assert mixed.where(F.col("copy") > 3).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == mixed.count()


def test_near_duplicate_stage_keeps_one_of_each(spark):
    rng = random.Random(9)
    base = [f"x{rng.randrange(300)}" for _ in range(120)]
    rows = [(7, " ".join(base)), (5, " ".join(base[:-1])), (9, " ".join(reversed(base))), (None, " ".join(base)), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.dedup_documents(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [5, 9, 11]


def test_near_duplicate_stage_decides_by_row(spark):
    """Null ids go after others, repeated rows stay once, and a row that only shares its id with a copy stays."""
    rng = random.Random(4)
    text = lambda: " ".join(f"y{rng.randrange(400)}" for _ in range(100))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a, "en"), (None, a + " more", "en"), (2, b, "en"), (2, b, "en"), (2, b, None), (3, a, "en"), (3, c, "en"), (None, d, "en"), (None, d, "en"), (None, d + " more", "en"), (4, e, "en"), (4, e + " more", "en"), (5, "", None), (5, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"]) for r in cp.dedup_documents(spark, docs, "").collect()]
    assert {(1, a), (2, b), (3, c), (5, "")} <= set(got)
    assert len([g for g in got if g[1] == a or g[1] == a + " more"]) == 1 and got.count((2, b)) == 1 and got.count((3, c)) == 1
    assert len([g for g in got if g[1] and g[1].startswith(d)]) == 1 and len([g for g in got if g[1] and g[1].startswith(e)]) == 1
    assert got.count((5, "")) == 2 and got.count((None, None)) == 1 and len(got) == 8  # rows without words are in no group


def test_every_stage_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, repeats, long texts and clashing names pass all stages; an empty table gives an empty one."""
    spark.createDataFrame([(1, "a benchmark item of ten words that stands nowhere else")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.count() <= odd.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
    mixed = cp.STAGES[-1][1](spark, odd, str(tmp_path))
    assert set(mixed.columns) == set(odd.columns) and mixed.where("copy not between 1 and 3").count() == 0
    assert cp.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
