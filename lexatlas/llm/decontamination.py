"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the passages.

A test item's n-grams are looked up in all documents twice. The first pass counts the documents of each n-gram; of an
item's n-grams those that are rare, and the rarest of any few neighbours, become seeds, so that common phrases bring no
candidates while every stretch of an item keeps one, however often it leaked. The second pass cuts a passage around each
place where seeds fall and aligns it with the item, word by word: substitutions, insertions and gaps cost, so edited
and paraphrased copies score as far as they agree.

The items' side is the small one. It is taken in slices of bounded size, each held by the tasks as sorted arrays;
a larger benchmark makes more slices, not larger ones. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import PLAIN, run_hashes, slices, word_hashes
from ._work import saved

#: Words of a seed; documents that a seed may be in without being common; neighbours of which one stays a seed.
SEED, RARE, NEAR = 3, 20, 4
#: Scores of a matching and a differing pair of words, and of a word without partner.
MATCH, DIFFER, GAP = 2, -1, -1
#: Share of an item's best possible score from which a passage counts as a copy.
COPY = 0.5
#: Words of items in a slice: bounds what a task holds (about 40 bytes a word).
SLICE = 500_000


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words in lower case without ASCII punctuation: (hashes, first word of each text and one past the last)."""
    return word_hashes(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), False, PLAIN)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of an item's words in a passage; of equals the first to end.

    Row by row over the item; gaps along the passage are a running maximum.
    """
    n = len(passage)
    slope = -GAP * np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    best, end, start = 0, 0, 0
    for w in item:
        step = np.where(passage == w, MATCH, DIFFER)
        new = np.zeros(n + 1, np.int64)
        came = np.arange(n + 1)
        diagonal, above = h[:-1] + step, h[1:] + GAP
        take = diagonal >= above
        value = np.where(take, diagonal, above)
        new[1:] = np.maximum(value, 0)
        came[1:] = np.where(value > 0, np.where(take, origin[:-1], origin[1:]), came[1:])
        # a gap: from the last place whose score, less the way, is highest
        lifted = new + slope
        run = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        gapped = run - slope
        better = gapped > new
        h, origin = np.where(better, gapped, new), np.where(better, came[at], came)
        k = int(np.argmax(h))
        if h[k] > best:
            best, end, start = int(h[k]), k, int(origin[k])
    return best, start, end


@dataclass
class Items:
    """A slice of the benchmark: words of all items, and seeds with the places they have in items."""

    ids: list
    words: np.ndarray
    firsts: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str], size: int) -> Items:
        words, firsts = plain_words(pa.array(texts, pa.string()))
        seeds, item, at = [], [], []
        for i, (s, e) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
            if e > s:
                g = run_hashes(words[s:e], min(size, e - s))
                seeds.append(g)
                item += [i] * len(g)
                at += range(len(g))
        return Items(ids, words, firsts, np.concatenate(seeds or [np.zeros(0, np.uint64)]), np.array(item, np.int64), np.array(at, np.int64))

    def chosen(self, df: dict[int, int], rare: int, near: int) -> Items:
        """With rare seeds only: at most ``rare`` documents or the item's median, and the rarest of any ``near`` in a row."""
        n = np.array([df.get(int(s), 0) for s in self.seeds.view(np.int64)], np.int64)
        keep = np.zeros(len(n), bool)
        for i in np.unique(self.seed_item):
            at = np.flatnonzero(self.seed_item == i)
            own = n[at]
            keep[at[own <= max(rare, np.median(own))]] = True
            for k in range(max(1, len(own) - near + 1)):
                keep[at[k + int(np.argmin(own[k : k + near]))]] = True
        return Items(self.ids, self.words, self.firsts, self.seeds[keep], self.seed_item[keep], self.seed_at[keep])


def _places(words: np.ndarray, firsts: np.ndarray, items: Items, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where seeds fall: (text, word, which distinct seed), for seeds of all lengths up to ``size``."""
    distinct = np.unique(items.seeds)
    out = []
    lengths = {size} | {int(e - s) for s, e in zip(items.firsts[:-1], items.firsts[1:], strict=True) if 0 < e - s < size}
    for n in sorted(lengths):
        g = run_hashes(words, n)
        if not len(g) or not len(distinct):
            continue
        k = np.minimum(np.searchsorted(distinct, g), len(distinct) - 1)
        at = np.flatnonzero(distinct[k] == g)
        text = np.searchsorted(firsts, at, "right") - 1
        ok = at + n <= firsts[text + 1]
        out.append((text[ok], at[ok], k[at[ok]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _passages(words: np.ndarray, firsts: np.ndarray, items: Items, size: int, copy: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, score, start, end) of the best passage of each text and item that reaches the wanted share."""
    distinct = np.unique(items.seeds)
    order = np.argsort(items.seeds, kind="stable")
    edges = np.searchsorted(items.seeds[order], distinct)
    counts = np.diff(np.append(edges, len(order)))
    text, at, k = _places(words, firsts, items, size)
    if not len(text):
        return
    # every item that has the seed
    rep = np.repeat(np.arange(len(text)), counts[k])
    inner = np.arange(len(rep)) - np.repeat(np.cumsum(counts[k]) - counts[k], counts[k])
    which = order[edges[k[rep]] + inner]
    item, text, at = items.seed_item[which], text[rep], at[rep]
    length = items.firsts[item + 1] - items.firsts[item]
    slack = length // 3 + 2
    low = np.maximum(firsts[text], at - items.seed_at[which] - slack)
    high = np.minimum(firsts[text + 1], at - items.seed_at[which] + length + slack)
    o = np.lexsort((low, item, text))
    text, item, low, high = text[o], item[o], low[o], high[o]
    group = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
    # merge overlapping passages within a group
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    i = 0
    n = len(text)
    t, m, lo, hi, gr = text.tolist(), item.tolist(), low.tolist(), high.tolist(), group.tolist()
    while i < n:
        j, end = i + 1, hi[i]
        while j < n and gr[j] == gr[i] and lo[j] <= end:
            end = max(end, hi[j])
            j += 1
        own = items.words[items.firsts[m[i]] : items.firsts[m[i] + 1]]
        passage = words[lo[i] : end]
        # no more words can match than the passage has of the item's
        if MATCH * int(np.isin(own, passage).sum()) >= copy * MATCH * len(own):
            score, s, e = align(own, passage)
            key = (t[i], m[i])
            if score >= copy * MATCH * len(own) and score > best.get(key, (0, 0, 0))[0]:
                best[key] = (score, lo[i] + s - firsts[t[i]], lo[i] + e - firsts[t[i]])
        i = j
    for (a, b), (score, s, e) in best.items():
        yield a, b, score, int(s), int(e)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", copy: float = COPY, size: int = SEED, rare: int = RARE, near: int = NEAR) -> DataFrame:
    """(key, item key, score, start_word, end_word) for each document and item with a passage whose alignment reaches
    ``copy`` of the item's best possible score; the passage is the best one, in words of the document as split here
    (lower case, ASCII punctuation left out).

    A seed is in a copy unless no ``near`` + ``size`` - 1 neighbouring words of the item survived unedited. Items with
    fewer words than a seed are their own seed; items without words, null texts and empty tables match nothing. Keys may
    be null or repeated: each row is judged and named by its key. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, item long, score double, start_word long, end_word long"
    numbered = items.select(F.col(item_key).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = numbered.agg(F.sum(F.coalesce(F.regexp_count("t", F.lit(r"\S+")), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-int(total) // SLICE))
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("item", "t"), F.lit(parts)))
    found: list[DataFrame] = []
    for part in range(parts):
        mine = dealt.where(F.col("part") == part).collect()  # about SLICE words
        held = Items.of([r["item"] for r in mine], [r["t"] for r in mine], size)

        def count(batches: Iterator[pa.RecordBatch], held: Items = held) -> Iterator[pa.RecordBatch]:
            distinct = np.unique(held.seeds)
            n = np.zeros(len(distinct), np.int64)
            for b in slices(batches, "t"):
                words, firsts = plain_words(b.column("t"))
                where, _, k = _places(words, firsts, held, size)
                pairs = np.unique(where * max(len(distinct), 1) + k)
                n += np.bincount(pairs % max(len(distinct), 1), minlength=len(distinct))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(distinct[some].view(np.int64)), pa.array(n[some])], ["seed", "n"])

        df = {r["seed"]: r["n"] for r in rows.select("t").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()}
        rareness = held.chosen(df, rare, near)

        def judge(batches: Iterator[pa.RecordBatch], held: Items = rareness) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "t"):
                words, firsts = plain_words(b.column("t"))
                got = list(_passages(words, firsts, held, size, copy))
                at = pa.array([g[0] for g in got], pa.int64())
                full = [MATCH * int(held.firsts[g[1] + 1] - held.firsts[g[1]]) for g in got]
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] / f for g, f in zip(got, full, strict=True)], pa.float64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())], [key, "item", "score", "start_word", "end_word"])

        names = spark.createDataFrame(list(enumerate(held.ids)), f"item long, `{item_key}` {items.schema[item_key].dataType.simpleString()}")
        found.append(rows.mapInArrow(judge, kinds).join(names, "item"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(key, item_key, "score", "start_word", "end_word")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item; all columns stay as they are.

    Rows are matched by key and text, so a clean row that shares its key with a copy stays. The list of copies is written
    first, and each task's rows are looked up in it by hash; it's small beside the documents but its size isn't assumed.
    """
    marked = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("row"), F.col(text).alias("t"))
    bad = saved(leaks(marked, items, "t", "row", **options).select("row").distinct(), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("row"))
    return rows.join(bad, "row", "left_anti").select("d.*")
