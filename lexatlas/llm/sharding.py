"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a ring of ``2 ** bits`` places, and each shard owns many points on it. A key belongs to the next point clockwise;
where that shard is full it goes on, past full shards, to the next one with room (Mirrokni, Thorup and Zadimoghaddam, 2018). So no shard
ever exceeds its bound, and a change of the number of shards moves little more than the rows that the new shard takes.

Only the number of rows at each place decides who overflows, so the walk runs over a table of at most ``2 ** bits`` counts.
Places fill the ring in one fixed, hashed order, whatever the number of shards, which keeps those that overflow the same. What
fits only partly is cut: a place's rows have a fixed order, and each shard takes a run of it. A place that very many rows share, such as
that of a null key, is spread over shards in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._work import drop, saved

#: Points of each shard on the ring; places of the ring as a power of two; shards of the registered query.
POINTS, BITS, SHARDS = 256, 16, 24
#: Bytes that a document needs beside its text.
HEAD = 8


def ring(shards: int, points: int = POINTS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, shard) of all points in clockwise order; points at one place stand in the order of their shards."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") >> (64 - bits), s) for s in range(shards) for v in range(points)]
    place, shard = zip(*sorted(at), strict=True)
    return np.array(place), np.array(shard)


def turn(places: np.ndarray) -> np.ndarray:
    """The fixed order in which places come: their numbers times an odd constant, modulo 2 ** 64."""
    return np.argsort(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: (1 + slack) times the mean, rounded up; without slack, counts that differ by one at most."""
    if slack:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(loads: Iterable[tuple[int, int]], shards: int, slack: float = 0.0, points: int = POINTS, bits: int = BITS) -> list[tuple[int, int, int, int, int]]:
    """(place, shard, low, high, slot): rows low to high - 1 of a place go to a shard, from slot on.

    ``loads`` has the number of rows at each place that has any. Full shards' points are left out of the ring as they are met.
    """
    loads = sorted(loads)
    if not loads:
        return []
    place, owner = ring(shards, points, bits)
    room, filled = bounds(sum(n for _, n in loads), shards, slack), [0] * shards
    after = list(range(len(owner)))

    def open_point(i: int) -> int:
        """The next point clockwise whose shard has room; what lies between is skipped from now on."""
        passed = []
        while True:
            if after[i] != i:
                passed.append(i)
                i = after[i]
            elif filled[owner[i]] >= room[owner[i]]:
                after[i] = (i + 1) % len(owner)
            else:
                break
        for p in passed:
            after[p] = i
        return i

    places = np.array([p for p, _ in loads])
    start = np.searchsorted(place, places) % len(owner)
    out = []
    for k in turn(places):
        low, n, i = 0, loads[k][1], int(start[k])
        while low < n:
            i = open_point(i)
            s = int(owner[i])
            high = min(n, low + room[s] - filled[s])
            out.append((int(places[k]), s, low, high, filled[s]))
            filled[s] += high - low
            low = high
    return out


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, points: int = POINTS, bits: int = BITS) -> DataFrame:
    """``docs``, or their columns ``keep``, with size, text_crc32, shard and slot, for any number of shards.

    Each row goes to one shard of 0 to ``shards`` - 1; no shard gets more than (1 + ``slack``) times the mean, and without slack, the
    default, the shards' numbers of rows differ by one at most. ``slot`` numbers a shard's rows from 0 without gaps, in an order that is
    pseudo-random and depends on keys and texts alone. size: UTF-8 bytes of the text plus 8; text_crc32: of the text's UTF-8. Null
    texts count as empty. A null key is a key like any other; rows with one key are neighbours on the ring, and however many
    they are, those beyond a shard's bound go on clockwise. Rows with the same key and text are interchangeable: which of
    them gets which of their slots depends on the order in which they are read. An empty table gives an empty table. Columns named
    size, text_crc32, shard or slot are replaced.

    What is read twice is narrow unless ``keep`` holds long columns. Rows are dealt by ranges of (place, key, text, row), so rows
    of one place or key are split; the counts, the cuts and the ranges' sizes have at most 2 ** bits rows plus one for each cut or range.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "shard", "slot")]
    whole, k = F.coalesce(F.col(text), F.lit("")), F.xxhash64(F.col(key).cast("string"))
    row = docs.select(
        F.shiftrightunsigned(k, 64 - bits).cast("int").alias("place"), k.alias("k"), F.xxhash64(whole).alias("th"), (F.octet_length(whole) + HEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("crc"), F.struct(*names).alias("d"), F.monotonically_increasing_id().alias("row"),
    )
    rows = saved(row, "shard-rows")
    cuts = walk([(r["place"], r["count"]) for r in rows.groupBy("place").count().collect()], shards, slack, points, bits)
    order = ["place", "k", "th", "crc", "size", "row"]
    # numbers grow along the order: by range, then by row within it
    dealt = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("k", "th", "row").withColumn("at", F.monotonically_increasing_id()), "shard-order")
    drop(rows)
    part = F.shiftright("at", 33).alias("part")
    runs = dealt.groupBy("place", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("place").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = saved(runs.select("place", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero")), "shard-runs")
    cut = spark.createDataFrame(cuts, "place int, shard int, low long, high long, slot long")
    # both are bounded by the ring's places, plus the cuts or the ranges
    placed = dealt.withColumn("part", part).join(F.broadcast(runs), ["place", "part"]).withColumn("i", F.col("at") - F.col("zero"))
    out = placed.join(F.broadcast(cut), "place").where((F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")))
    return out.select(*[F.col("d").getField(c).alias(c) for c in names], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("i") - F.col("low")).alias("slot"))
