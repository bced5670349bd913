"""Substring dedup: words covered by long windows that repeat in an earlier document go.

Level-wise doubling (:func:`levels`; for 50 words: 6, 12, 24, then 50): only windows that repeat at one length, in two
different texts, are extended to twice that length, and the levels end early where no candidate survives. The first
level looks at anchors: in each run of positions that one full window spans, the shortest windows of least hash. Equal
full windows contain equal short windows and so the same anchors, hence a full window that repeats has an anchor that
repeats, and about one position in twenty-three stands for all.

A window is extended by its own length to the right or to the left; one of both stays inside each full window that holds
it, so no repeat is lost. The pass over the texts that finds the anchors notes the hashes of their extensions, so the
levels between join narrow rows and read no text. Full windows are hashed from the texts again, only around what survived
the last level, and judged by a longer hash.

Texts that are equal as a whole are told by their hash and take part once, under their smallest document id; the other
copies are removed as a whole. So a group of copies of any size costs one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import run_hashes, signed, slices, word_hashes
from ._work import drop, saved

#: Orders a null id after all others.
LAST = (1 << 63) - 1


def _address(text: str) -> dict[str, Column]:
    """Two halves of a text's 128-bit hash."""
    return {"ck": F.xxhash64(text), "c2": F.xxhash64(F.lit("text"), text)}


def _column(level: int, offset: int) -> str:
    return f"h{level}_{-offset}"


def _slide(x: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + size] for each i, by doubling."""
    have, out = 1, x
    while have * 2 <= size:
        out = op(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    if have < size and len(out):
        shift = size - have
        out = op(out[:-shift], out[shift:]) if len(out) > shift else out[:0]
    return out


def levels(window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(length, offsets from the anchor) of the windows of each level below ``window``.

    Doubling goes on while the half that overlaps can be on either side: a window of length n inside a full one can be
    extended by n to the right or to the left within it as long as the full one has 3n - 1 words.
    """
    size, offsets = max(1, window // 8), (0,)
    out = [(size, offsets)]
    while window >= 3 * size - 1 and 2 * size < window:
        offsets = tuple(sorted({x for d in offsets for x in (d, d - size)}))
        size *= 2
        out.append((size, offsets))
    return out


def anchors(words: np.ndarray, firsts: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all texts of a batch: windows of ``size`` that are least in some full window."""
    span = window - size + 1
    g = run_hashes(words, size)
    least = _slide(g, span, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # only windows inside one text count
    last = np.repeat(firsts[1:], np.diff(firsts))[: len(least)]
    least = np.where(np.arange(len(least)) + window <= last, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    top = _slide(np.concatenate([pad, least, pad]), span, np.maximum)[: len(g)]
    at = np.flatnonzero((g == top) & (top != 0))
    return at, g[at]


def repeating(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (h, ck, c2, ...) whose hash ``h`` occurs in two different texts; written."""
    # the hashes that repeat are written, so that the join with them can be split where one is hot
    ends = rows.groupBy("h").agg(F.min("ck").alias("a"), F.max("ck").alias("b"), F.min("c2").alias("c"), F.max("c2").alias("d"))
    twice = saved(ends.where("a < b or c < d").select("h"), f"repeats-twice-{name}")
    alive = saved(rows.join(twice, "h"), f"repeats-alive-{name}")
    drop(twice)
    return alive


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): every word that lies in a window of ``window`` words whose word sequence also
    starts in a document with a smaller ``key`` is removed; ``kept`` joins the others by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged; all windows are judged on the input. Null text: no words. Texts
    of fewer than ``window`` words lose nothing. A null key comes after all others. Rows with one key and different
    texts are judged one by one (equal keys are not smaller); repeated rows each get their result. Other columns,
    whatever their names, are left out. Hashes of full windows have 96 bits, of whole texts 128.
    """
    steps = levels(window)
    base, reach = steps[0][0], steps[-1][0]
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = ids.withColumns(_address("t"))
    first = saved(ids.groupBy("ck", "c2").agg(F.min("id").alias("rep")), "repeats-texts")
    longer = [(k, d) for k, (_, offsets) in enumerate(steps) if k for d in offsets]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            # copies within a batch say the same
            _, one = np.unique(np.stack([b.column("ck").to_numpy(), b.column("c2").to_numpy()]), axis=1, return_index=True)
            b = b.take(pa.array(np.sort(one)))
            words, firsts = word_hashes(b.column("t"), False)
            at, h = anchors(words, firsts, window, base)
            row = np.searchsorted(firsts, at, "right") - 1
            more = []
            for size, offsets in steps[1:]:
                runs = run_hashes(words, size)
                for d in offsets:
                    start = at + d
                    inside = (start >= firsts[row]) & (start + size <= firsts[row + 1])
                    got = np.zeros(len(at), np.uint64)
                    got[inside] = runs[start[inside]]
                    more.append(pa.array(signed(got), mask=~inside))
            own = [pa.array(b.column(c).to_numpy()[row]) for c in ("ck", "c2")]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), *own, pa.array((at - firsts[row]).astype(np.int32)), *more], ["h", "ck", "c2", "pos", *[_column(k, d) for k, d in longer]])

    kept = "".join(f", `{_column(k, d)}` long" for k, d in longer)
    found = saved(ids.select("t", "ck", "c2").mapInArrow(emit, f"h long, ck long, c2 long, pos int{kept}"), "repeats-anchors")
    alive = repeating(found.withColumn("d", F.lit(0)), str(base))
    drop(found)
    for k, (size, offsets) in enumerate(steps[1:], 1):
        if alive.isEmpty():
            break
        before = steps[k - 1][0]
        # each survivor goes on to both sides; windows that two survivors reach are one row
        sides = F.array(*[F.struct(F.lit(d).alias("d"), F.col(_column(k, d)).alias("h")) for d in offsets])
        later = [_column(j, d) for j, d in longer if j > k]
        wide = alive.select("ck", "c2", "pos", *later, F.explode(F.filter(sides, lambda s: s["h"].isNotNull() & ((s["d"] == F.col("d")) | (s["d"] == F.col("d") - before)))).alias("s"))
        rows = wide.groupBy("ck", "c2", "pos", F.col("s.d").alias("d")).agg(F.first("s.h").alias("h"), *[F.first(c).alias(c) for c in later])
        rows = saved(rows, f"repeats-windows-{size}")
        drop(alive)
        alive = repeating(rows, str(size))
        drop(rows)
    ends = alive.groupBy("ck", "c2").agg(F.collect_set(F.col("pos") + F.col("d")).alias("at"))
    last = saved(ends.join(first, ["ck", "c2"]), "repeats-alive")
    drop(alive)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 1 << 20):
            words, firsts = word_hashes(b.column("t"), False)
            lists = b.column("at")
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            pos = lists.flatten().to_numpy() + firsts[row]
            # starts of full windows that hold a surviving one: [its start - (window - reach), its start]
            edge = np.zeros(len(words) + 2, np.int32)
            np.add.at(edge, np.maximum(pos - (window - reach), firsts[row]), 1)
            np.add.at(edge, pos + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[: len(words)]) > 0)
            row = np.searchsorted(firsts, at, "right") - 1
            ok = at + window <= firsts[row + 1]
            at, row = at[ok], row[ok]
            if len(at):
                h, h2 = run_hashes(words, window)[at], run_hashes(words, window, True)[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(h2).astype(np.int32)), pa.array(b.column("rep").to_numpy()[row]), *[pa.array(b.column(c).to_numpy()[row]) for c in ("ck", "c2")], pa.array((at - firsts[row]).astype(np.int32))], ["h", "h2", "id", "ck", "c2", "pos"])

    # repeated rows of one document say the same twice, which changes nothing below
    once = ids.withColumnRenamed("id", "rep").join(last, ["ck", "c2", "rep"]).select("t", "ck", "c2", "rep", "at")
    wide = saved(once.mapInArrow(widen, "h long, h2 int, id long, ck long, c2 long, pos int"), f"repeats-windows-{window}")
    owner = saved(wide.groupBy("h", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "h2", "least"), "repeats-owner")
    flagged = wide.join(owner, ["h", "h2"]).where("id > least").groupBy("ck", "c2").agg(F.collect_set("pos").alias("starts"))
    marks = saved(first.join(flagged, ["ck", "c2"], "left"), "repeats-marks")
    drop(first, last, wide, owner)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            total, removed, kept = [], [], []
            starts, whole = b.column("starts"), b.column("copy").to_pylist()
            for i, t in enumerate(b.column("t").cast(pa.large_binary())):
                words = t.as_py().split()
                total.append(len(words))
                if whole[i] and len(words) >= window:
                    words = []
                elif starts[i].is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s = starts[i].values.to_numpy()
                    edge[s] += 1  # starts are distinct, and so are ends
                    edge[s + window] -= 1
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "n_removed", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumns(_address("t"))
    judged = rows.join(marks, ["ck", "c2"]).select("key", "t", (F.col("id") > F.col("rep")).alias("copy"), "starts")
    kind = docs.schema[key].dataType.simpleString()
    return judged.mapInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, kept string")
