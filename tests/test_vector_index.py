import re

import numpy as np
import pytest

from lexatlas.operators import batch, vector_index


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 16)) for c in centres])
    x[100:400] = x[100]  # a hot vector
    x = x / np.linalg.norm(x, axis=1)[:, None]
    base = spark.createDataFrame([(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)] + [(5000, None, 0)], "id long, embedding array<float>, label int").repartition(6)
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    return base, vector_index.build(base, path, lists=20), path


def rows(df):
    return sorted(map(tuple, df.select("question", "rank", "id", "similarity").collect()))


def asking(base, every=50):
    return base.where(f"id % {every} = 0 and embedding is not null").select(base["id"].alias("question"), "embedding")


def test_exact_and_few_files(spark, clustered):
    base, index, path = clustered
    asked = asking(base)
    exact = rows(batch.nearest(base, asked, 10))
    assert rows(index.search(asked, 10)) == exact and len(exact) == 10 * asked.count()
    assert rows(vector_index.load(spark, path).search(asked, 10)) == exact
    # one question's search reads the files of a few lists, and the plan says so before it runs
    one = asked.where("question = 450")
    q = np.array([one.first()["embedding"]], np.float64)
    chosen = np.zeros((1, 20), bool)
    chosen[0, int((q @ index.centroids.T).argmax())] = True
    probed = index._probed(index.rows, q, chosen, 10)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#", plan)
    own = index.rows.where(f"list = {int(np.flatnonzero(chosen[0])[0])}").select("_metadata.file_path").distinct().count()
    assert own < len(index.rows.inputFiles()) / 4
    kth = min(r[3] for r in rows(index.search(one, 10)))
    assert (index.bounds(q) >= kth).sum() < 10
    bound = index.bounds(q)[0]
    for r in index.rows.select("list", "embedding").collect():
        assert float(np.dot(q[0], r["embedding"])) <= bound[r["list"]]


def test_all_rows_once_and_calibration(clustered):
    base, index, _ = clustered
    assert sorted(r["id"] for r in index.rows.select("id").collect()) == list(range(1200))
    assert index.probes < 20
    asked = asking(base, 20)
    got = vector_index.recall(index.search(asked, 40, exact=False), batch.nearest(base, asked, 40)).agg({"recall": "avg"}).first()[0]
    assert got >= 0.9


def test_filter_add_and_empty(spark, clustered, tmp_path):
    base, index, _ = clustered
    asked = asking(base, 100)
    only = base.where("label = 1")
    assert rows(index.search(asked, 7, only=only)) == rows(batch.nearest(only, asked, 7))
    half = vector_index.build(base.where("id < 500"), str(tmp_path / "half"), lists=5)
    grown = half.add(base.where("id >= 500"))
    assert rows(grown.search(asked, 12)) == rows(batch.nearest(base, asked, 12))
    assert rows(vector_index.load(spark, str(tmp_path / "half")).search(asked, 12)) == rows(batch.nearest(base, asked, 12))
    assert index.search(asked.limit(0), 3).count() == 0
    none = vector_index.build(base.limit(0), str(tmp_path / "none"))
    assert len(none.centroids) == 1


def test_query_recall(spark):
    from lexatlas.plans import workload

    for sf in ("sf0.001", "sf0.01"):
        assert workload.QUERIES["vector_index_recall"](spark, f"/root/testdata/{sf}").agg({"recall": "avg"}).first()[0] >= 0.9
