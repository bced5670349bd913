"""Connected components of an edge table by alternating star contractions; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import drop, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of ``edges`` the smallest node that it reaches.

    Large and small stars in turn (Kiveris et al., 2014): each node hangs its larger, then its smaller neighbours on the
    least one it knows. Every turn is a group-by minimum with partial sums and a join, written in the shared folder. The
    minima are written before they are joined: adaptive execution can't split a join over an aggregate of the same
    exchange, but it can split this one, so a hub costs rows, never one task. Ends when a turn changes nothing. Edges with a
    null end, and of a node with itself, link nothing and name no node; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = saved(e, "edges"), None
    while True:
        n, x = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, x) == before:
            break
        before = (n, x)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = saved(least, "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "edges")
        # small star: of each node and its smaller neighbours, all hang on the least
        smaller = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        new = saved(small, "edges")
        drop(e, least, smaller, large)
        e = new
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
