"""Corpus-wide counts of hashed items, exact and without a broadcast.

Documents are dealt into blocks. Each block counts its own distinct items once and ships them in sorted runs, one run
per part of the hash range; each part adds up the blocks' counts and answers every block with the totals that differ
from what the block already knows. So an item in a third of all documents is one entry per block, an item of one block
costs no answer, and rows are runs of thousands of items rather than single items. All figures follow the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import slices, trim
from ._work import saved

#: Bytes of text per block.
BLOCK_BYTES = 8 << 20
#: Items gathered before a block's counts are shipped; a larger block ships more runs.
MOST_ITEMS = 4_000_000

RUNS = "part long, block long, items binary, counts binary"
ANSWERS = "block long, part long, places binary, totals binary, seen long, kinds long, once long, twice long"


def in_block(docs: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``docs`` with the column ``block`` that :func:`with_block` gives them, not dealt: a later grouping by it deals them once."""
    return docs.withColumn("block", F.pmod(F.hash(key), F.lit(blocks)).cast("long"))


def with_block(docs: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``docs`` dealt into blocks by ``key``; the column ``block`` says which, and each block is one partition."""
    return in_block(docs, key, blocks).repartition(blocks, key)


def packed(x: np.ndarray, climbing: bool = False) -> bytes:
    """Whole numbers as bytes that compress: differences where they climb, then all lowest bytes first, all next, ..."""
    x = x.astype(np.uint64)
    if climbing:
        x = np.diff(x, prepend=np.uint64(0))
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, climbing: bool = False) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if climbing else x


def placed(items: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct items in order, sum of each one's weights, where each item stands among the distinct ones)."""
    order = np.argsort(items)
    items = items[order]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    starts = np.flatnonzero(new)
    items = items[starts]
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return items, np.add.reduceat(weights[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64), place


def tally(items: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct items in order, sum of each one's weights)."""
    if not len(items):
        return items, np.zeros(0, np.int64)
    order = np.argsort(items)
    items = items[order]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    return items[starts], np.add.reduceat(weights[order], starts, dtype=np.int64)


def _part(items: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash range that each item falls in."""
    return (items >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def runs(block: int, items: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A block's tally cut into one run per part of the hash range."""
    part = _part(items, parts)
    edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int64)),
            pa.array(np.full(len(full), block, np.int64)),
            pa.array([packed(items[edges[i] : edges[i + 1]], True) for i in full], pa.binary()),
            pa.array([packed(counts[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
        ],
        ["part", "block", "items", "counts"],
    )


def count_blocks(dealt: DataFrame, text: str, items_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """Runs of all blocks. ``items_of`` gives (items, weights) of a batch of documents; a weight may be 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for b in slices(batches, text):
            block = b.column("block").to_numpy()
            for k in np.unique(block).tolist():
                own = b.filter(pa.array(block == k))
                got = tally(*items_of(own))
                held.setdefault(k, []).append(got)
                size += len(got[0])
            if size > MOST_ITEMS:
                for k, x in held.items():
                    yield runs(k, *tally(np.concatenate([i for i, _ in x]), np.concatenate([w for _, w in x])), parts)
                held, size = {}, 0
        for k, x in held.items():
            yield runs(k, *tally(np.concatenate([i for i, _ in x]), np.concatenate([w for _, w in x])), parts)

    return dealt.mapInArrow(run, RUNS)


def answers(shipped: DataFrame, name: str) -> DataFrame:
    """For each block the items whose total differs from its own count, with the totals; written in the shared folder.

    Rows with a block below 0 carry statistics: for items of kind ``kinds`` (their lowest bit), ``seen`` is the sum of
    totals, ``once`` and ``twice`` the numbers of items with that total, and -1 - block the number with any.
    """

    def add(t: pa.Table) -> pa.Table:
        trim()
        block = t.column("block").to_numpy()
        lists = [unpacked(x.as_py(), True) for x in t.column("items")]
        n = [len(x) for x in lists]
        items = np.concatenate(lists)
        counts = np.concatenate([unpacked(x.as_py()) for x in t.column("counts")]).astype(np.int64)
        owner = np.repeat(block.astype(np.int32), n)
        del lists
        order = np.lexsort((owner, items))
        items, owner, counts = items[order], owner[order], counts[order]
        del order
        # one entry per item and block
        new = np.concatenate([[True], (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])])
        at = np.flatnonzero(new)
        counts, items, owner = np.add.reduceat(counts, at), items[at], owner[at]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        sums = np.add.reduceat(counts, first)
        total = np.repeat(sums, np.diff(np.append(first, len(items))))
        # by block, an item's place among the block's own distinct items of this part: the block finds it there again
        o = np.argsort(owner, kind="stable")
        who = owner[o]
        to, starts = np.unique(who, return_index=True)
        place = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
        more = (total > counts)[o]
        who, place, how = who[more], place[more], total[o][more]
        edges = np.searchsorted(who, to), np.searchsorted(who, to, "right")
        part = t.column("part")[0].as_py()
        none = {"part": None, "places": None, "totals": None, "seen": None, "kinds": None, "once": None, "twice": None}
        rows = [none | {"block": int(k), "part": part, "places": packed(place[s:e], True), "totals": packed(how[s:e])} for k, s, e in zip(to, *edges, strict=True) if e > s]
        kind = items[first] & np.uint64(1)
        for k in (0, 1):
            s = sums[kind == k]
            rows.append(none | {"block": -1 - int((s > 0).sum()), "seen": int(s.sum()), "kinds": k, "once": int((s == 1).sum()), "twice": int((s == 2).sum())})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("part", pa.int64()), ("places", pa.binary()), ("totals", pa.binary()), ("seen", pa.int64()), ("kinds", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())]))

    return saved(shipped.groupBy("part").applyInArrow(add, ANSWERS), name)


def statistics(answered: DataFrame, kind: int) -> tuple[int, int, int, int]:
    """(sum of totals, distinct items with a total above 0, items seen once, twice) of a kind."""
    r = answered.where((F.col("block") < 0) & (F.col("kinds") == kind)).agg(F.sum("seen"), F.sum(-1 - F.col("block")), F.sum("once"), F.sum("twice")).first()
    return tuple(int(x or 0) for x in r)


def known(answer: pa.Table, items: np.ndarray, own: np.ndarray, parts: int) -> np.ndarray:
    """Totals of a block's distinct ``items`` (in order): the answered ones, else the block's own counts."""
    total = own.astype(np.int64).copy()
    part = _part(items, parts)
    for k, places, how in zip(answer.column("part").to_pylist(), answer.column("places"), answer.column("totals"), strict=True):
        total[np.searchsorted(part, np.uint64(k)) + unpacked(places.as_py(), True).astype(np.int64)] = unpacked(how.as_py())
    return total
