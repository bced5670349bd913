"""An inverted-file index of vectors: rows stored by the centroid that they lie nearest to, so that a search reads few of them.

Centroids come from k-means over a bounded sample; every row is then assigned to its nearest and written to that list's partition.
Each list has a radius, the largest distance of a row from its centroid, and with q the question, c the centroid and r the radius, no
row of the list has a dot product with q above q . c + |q| r. An exact search probes the lists that look best and then only those whose bound
reaches the k-th similarity found. A search that isn't exact stops after its first probes, whose number is calibrated on the sample: the
least that finds the asked share of the sample's own neighbours. Vectors without clusters need many; then little can be left unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.operators import batch
from lexatlas.work import settled

#: Rows that k-means sees; its rounds; most lists; lists that are probed first. Room for rounding in a radius or bound.
SAMPLE, ROUNDS, LISTS, PROBES, ROOM = 20_000, 10, 4096, 4, 1e-6
#: Share of neighbours that a search by calibrated probes should find; neighbours and questions that calibrate.
RECALL, NEIGHBOURS, ASKED = 0.95, 40, 256


def kmeans(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's rounds from centroids far apart; empty ones move to the rows that lie farthest out."""
    unlike = np.unique(rows, axis=0)
    # each start is the row farthest from the starts before it
    centres = [unlike[0]]
    far = ((unlike - centres[0]) ** 2).sum(1)
    while len(centres) < min(lists, len(unlike)):
        centres.append(unlike[int(far.argmax())])
        far = np.minimum(far, ((unlike - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        mine, apart = nearest_list(rows, c)
        sums = np.zeros_like(c)
        np.add.at(sums, mine, rows)
        n = np.bincount(mine, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out = np.argsort(-apart)[: int((n == 0).sum())]
        c[np.flatnonzero(n == 0)[: len(out)]] = rows[out]
    return c


def calibrated(rows: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The least number of lists that hold ``recall`` of the neighbours of some of ``rows`` among all of them, on average.

    The sample's neighbours lie farther apart than those of all rows, so for these it rather probes too much."""
    asked = rows[:: max(1, len(rows) // ASKED)]
    near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    turn = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    place = np.take_along_axis(turn, nearest_list(rows, centroids)[0][near], axis=1)
    found = np.array([(place <= p).mean() for p in range(len(centroids))])
    return int(np.argmax(found >= recall)) + 1


def nearest_list(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance) of each row, some rows at a time."""
    mine, apart = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    size = (centroids**2).sum(1)
    for at in range(0, len(rows), batch.ROWS):
        part = rows[at : at + batch.ROWS]
        k = (size[None, :] - 2 * part @ centroids.T).argmin(1)
        mine[at : at + len(part)] = k
        apart[at : at + len(part)] = np.sqrt(((part - centroids[k]) ** 2).sum(1))
    return mine, apart


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, apart = nearest_list(batch.matrix(b.column("embedding")), centroids) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(apart), pa.array(mine.astype(np.int32))], names=[*b.schema.names, "apart", "list"])

    return run


@dataclass
class VectorIndex:
    """``rows``: all indexed rows, in partitions by list; ``centroids`` and ``radii`` of the lists, a bounded table; ``probes``: as calibrated."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    probes: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """No row of a list has a higher dot product with a question than this (questions by lists)."""
        return asked @ self.centroids.T + np.sqrt((asked**2).sum(1))[:, None] * self.radii[None, :] + ROOM

    def add(self, base: DataFrame) -> VectorIndex:
        """The index with the rows of ``base`` too. Radii are written first: one that is too wide loses nothing."""
        made = _placed(base, self.centroids)
        radii = np.maximum(self.radii, _radii(made, len(self.radii)))
        _write_lists(self.spark, self.path, self.centroids, radii, self.probes)
        _write_rows(made, self.path)
        return VectorIndex(self.spark, self.path, self.centroids, radii, self.probes)

    def search(self, questions: DataFrame, k: int = 40, exact: bool = True, probes: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """(question, id, similarity, rank): for each of ``questions`` (question, embedding) its ``k`` nearest rows, ids breaking ties.

        An exact search begins with ``probes`` lists (a few) and goes on to all that may hold better rows; one that isn't exact
        looks into ``probes`` lists (as calibrated) and no others. ``only`` (id) leaves other rows out before they are ranked.
        """
        rows = self.rows if only is None else self.rows.join(only.select("id"), "id", "left_semi")
        out = []
        for ids, asked in batch.slices(questions):
            bound = self.bounds(asked)
            best = np.argsort(-(asked @ self.centroids.T), axis=1, kind="stable")[:, : probes or (PROBES if exact else self.probes)]
            chosen = np.zeros(bound.shape, bool)
            np.put_along_axis(chosen, best, True, axis=1)
            found = [self._probed(rows, asked, chosen, k)]
            if exact:
                # the k-th similarities, one number a question
                named = batch.best(found[0].withColumnRenamed("q", "question"), [F.col("similarity").desc(), F.col("id")], k)
                kth = np.full(len(asked), -np.inf)
                for r in named.groupBy("question").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).where(F.col("n") == k).collect():
                    kth[r["question"]] = r["s"]
                more = (bound >= kth[:, None]) & ~chosen
                if more.any():
                    found.append(self._probed(rows, asked, more, k))
            names = self.spark.createDataFrame(list(enumerate(ids)), "q long, question long")
            out += [f.join(F.broadcast(names), "q").drop("q") for f in found]
        if not out:
            return batch.nearest(self.rows, questions, k)
        both = out[0]
        for x in out[1:]:
            both = both.unionByName(x)
        return batch.best(both.select("question", "id", "similarity"), [F.col("similarity").desc(), F.col("id")], k)

    def _probed(self, rows: DataFrame, asked: np.ndarray, chosen: np.ndarray, k: int) -> DataFrame:
        """(q, id, similarity): each task's best rows for each question, of the lists chosen for it. Other lists' files aren't read."""
        lists = [int(x) for x in np.flatnonzero(chosen.any(0))]
        return rows.where(F.col("list").isin(lists)).select("id", "embedding", "list").mapInArrow(batch.topmost(asked, k, chosen), "q long, id long, similarity double")


def _placed(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    kept = base.where("embedding is not null").drop("apart", "list")
    return settled(kept.mapInArrow(_assigned(centroids), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, apart double, list int"))


def _radii(placed: DataFrame, lists: int) -> np.ndarray:
    radii = np.zeros(lists)
    for r in placed.groupBy("list").agg(F.max("apart").alias("r")).collect():
        radii[r["list"]] = r["r"] + ROOM
    return radii


def _write_lists(spark: SparkSession, path: str, centroids: np.ndarray, radii: np.ndarray, probes: int) -> None:
    rows = [(i, [float(x) for x in c], float(r), probes) for i, (c, r) in enumerate(zip(centroids, radii, strict=True))]
    spark.createDataFrame(rows, "list int, centroid array<double>, radius double, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def _write_rows(placed: DataFrame, path: str) -> None:
    # a list with very many rows, such as one of equal vectors, becomes several files
    placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/rows")


def build(base: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> VectorIndex:
    """The index of all rows of ``base`` (id, embedding, and what else there is) under ``path``, a new folder.

    Rows without a vector are left out. The lists are about the square root of the number of rows, ``LISTS`` at most; the centroids
    are fitted on ``sample`` rows, those with the lowest hashes of their ids, and nothing else is judged by the sample.
    """
    spark, rows = base.sparkSession, base.where("embedding is not null")
    lists = lists or max(1, min(LISTS, int(rows.count() ** 0.5)))
    seen = rows.select("embedding", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("embedding").collect()
    width = len(seen[0][0]) if seen else 1
    rows_seen = np.array([r[0] for r in seen], np.float64).reshape(len(seen), width)
    centroids = kmeans(rows_seen, lists) if seen else np.zeros((1, width))
    probes = calibrated(rows_seen, centroids, recall) if seen else 1
    placed = _placed(rows, centroids)
    radii = _radii(placed, len(centroids))
    _write_lists(spark, path, centroids, radii, probes)
    _write_rows(placed, path)
    return VectorIndex(spark, path, centroids, radii, probes)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index that lies under ``path``."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # LISTS rows at most
    return VectorIndex(spark, path, np.array([r["centroid"] for r in lists]), np.array([r["radius"] for r in lists]), lists[0]["probes"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(question, recall): the share of the exact rows that were found."""
    hit = exact.select("question", "id").join(found.select("question", "id", F.lit(1).alias("hit")), ["question", "id"], "left")
    return hit.groupBy("question").agg((F.count("hit") / F.count("*")).alias("recall"))
