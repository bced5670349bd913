"""Ranked lexical search over a two-level index: bytes first, exact integers for what they leave.

The first level has, for each block of documents and term, the documents' places and their impacts as bytes, rounded upward. Summed
with the terms' weights they bound a score from above; less what rounding can have added, from below. A document whose upper bound is
under the k-th best lower bound can't be among the first k. All others, and none else, are scored again from the second level, which keeps
each document's terms and their exact counts. So no score is approximate, and no list is cut.

Equal texts have equal scores. The index holds each once, with the number of its copies, and the copies come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._text import PLAIN, slices, word_ranges
from ._work import drop, saved

#: Hits of each item. Documents and postings of a block at most (a longer text is a block of its own). Items that are searched together.
TOP, BLOCK, POSTINGS, TOGETHER = 50, 8192, 2 << 20, 1024
#: What the highest impact is below, and the width of one byte's step.
WHOLE = 1_000_000
STEP = -(-WHOLE // 255)
#: Rows of numbers, and of terms with a bound on their bytes, up to which a table is broadcast.
SMALL, SMALL_BYTES = 200_000, 16 << 20

_FORWARD = "block long, at int, h long, h2 long, copies long, first long, n long, terms array<string>, tfs array<int>"
_LISTS = "block long, term string, df long, places binary, impacts binary"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Index:
    """``forward``: the exact level, one row per distinct text with terms; ``lists``: the byte level, one row per block and term."""

    forward: DataFrame
    lists: DataFrame
    documents: int
    tokens: int


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats: runs of ASCII letters and digits and of longer characters; A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_TERM), F.lit(0))


def _hashes(text: str) -> list[Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("h"), F.xxhash64(whole, F.lit(1)).alias("h2")]


def _counted(most: int, postings: int):  # noqa: ANN202
    """Texts to their terms and counts; texts are dealt into blocks as they come."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches):
            data, starts, ends, firsts = word_ranges(batch.column("text"), PLAIN)
            rows = np.flatnonzero(np.diff(firsts))
            if not len(rows):
                continue
            # the terms' bytes without what stands between them are a string array's buffer
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            packed = data[data != 0x20]
            words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            pair, tf = np.unique(doc * len(words.dictionary) + code, return_counts=True)
            of, which = np.divmod(pair, len(words.dictionary))
            edges = np.searchsorted(of, np.append(rows, len(firsts))).astype(np.int32)
            blocks, places = [], []
            for size in np.diff(edges):
                if at and (at >= most or held + size > postings):
                    block, at, held = block + 1, 0, 0
                blocks.append(block)
                places.append(at)
                at, held = at + 1, held + int(size)
            kept = batch.take(pa.array(rows))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(edges), values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *[kept.column(c) for c in ("h", "h2", "copies", "first")], pa.array(np.diff(firsts)[rows], pa.int64()),
                    lists(words.dictionary.take(pa.array(which))), lists(pa.array(tf, pa.int32())),
                ],
                names=["block", "at", "h", "h2", "copies", "first", "n", "terms", "tfs"],
            )

    return count


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many postings, one row at least."""
    for batch in batches:
        ends, at = batch.column("terms").offsets.to_numpy(), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' terms and counts to lists of places and bytes, one for each block and term of a batch."""
    for batch in _parts(batches):
        terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
        words = terms.flatten().dictionary_encode()
        m, copies, at, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "copies", "at", "block"))
        impact = -(-(1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc])) // STEP)
        known, mine = np.unique(block, return_inverse=True)
        key = mine[doc] * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        edges = np.append(first, len(order))
        of, which = np.divmod(key[order][first], len(words.dictionary))
        df = np.add.reduceat(copies[doc][order], first)
        binary = lambda values, width: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[order]))])
        yield pa.RecordBatch.from_arrays([pa.array(known[of]), words.dictionary.take(pa.array(which)), pa.array(df, pa.int64()), binary(at[doc].astype(np.int32), 4), binary(impact.astype(np.uint8), 1)], names=["block", "term", "df", "places", "impacts"])


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = BLOCK, postings: int = POSTINGS) -> Index:
    """The index of all rows of ``docs``, in two written tables.

    Null texts have no terms, and texts without terms are in no list. Equal texts, told by 128 bits of hashes, are one entry that counts as
    often as it stands, so a text that very many rows share is one row after the partial aggregation. The lists depend on
    the number of documents and tokens, so the exact level is written first.
    """
    texts = docs.select(*_hashes(text), F.col(text).alias("text"), F.col(key).cast("long").alias("first")).groupBy("h", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("first").alias("first"))
    forward = saved(texts.select("h", "h2", "copies", "first", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted(most, postings), _FORWARD), "search-forward")
    n, total = forward.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("n")), F.lit(0))).first()
    m = F.lit(50) + F.expr(f"(50 * n * {n}L) div {max(1, total)}L")
    lists = saved(forward.select("block", "at", "copies", m.cast("long").alias("m"), "terms", "tfs").mapInArrow(_listed, _LISTS), "search-lists")
    return Index(forward, lists, n, total)


def _bounded(top: int):  # noqa: ANN202
    """The search of one block for a group of items: those documents whose upper bound reaches the block's own k-th lower bound."""

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        places = [np.frombuffer(p.as_py(), np.int32) for p in rows.column("places")]
        impacts = [np.frombuffer(p.as_py(), np.uint8) for p in rows.column("impacts")]
        block = rows.column("block")[0].as_py()
        asked = rows.column("asked").combine_chunks()
        row = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        item, weight = (asked.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("q", "w"))
        order = np.argsort(item, kind="stable")
        size, found = 1 + max(int(p.max()) for p in places), []
        for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            high, lost = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for k in part:
                p, w = places[row[k]], int(weight[k]) * STEP
                high[p] += w * impacts[row[k]].astype(np.int64)
                lost[p] += w
            met = np.flatnonzero(high)
            low = high[met] - lost[met]
            if len(met) > top:
                stay = high[met] >= np.partition(low, -top)[-top]
                met, low = met[stay], low[stay]
            found.append((np.full(len(met), item[part[0]]), met, high[met], low))
        q, at, high, low = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"q": pa.array(q, pa.int64()), "block": pa.array(np.full(len(q), block), pa.int64()), "at": pa.array(at, pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    return search


def _sized(t: DataFrame, *texts: str) -> DataFrame:
    """A written table, broadcast while its rows are few and its ``texts`` short."""
    n, size = t.agg(F.count("*"), F.coalesce(sum((F.sum(F.octet_length(c)) for c in texts), F.lit(0)), F.lit(0))).first()
    return F.broadcast(t) if n <= SMALL and size <= SMALL_BYTES else t


def candidates(index: Index, asked: DataFrame, top: int = TOP) -> DataFrame:
    """(q, block, at, high, low): all documents whose upper bound ``high`` reaches the item's ``top``-th lower bound.

    ``asked`` is a written table of (q, term, w). Blocks are searched apart, each within its own bound; the bound of all blocks then
    judges what they kept.
    """
    # a term's row takes along the items that hold it, by groups of items
    wanted = saved(asked.groupBy("term", F.expr(f"q div {TOGETHER}").alias("part")).agg(F.collect_list(F.struct("q", "w")).alias("asked")), "search-asked")
    met = index.lists.select("block", "term", "places", "impacts").join(_sized(wanted, "term"), "term").select("block", "part", "places", "impacts", "asked")
    found = saved(met.groupBy("block", "part").applyInArrow(_bounded(top), "q long, block long, at int, high long, low long"), "search-found")
    best = found.select("q", "low", F.row_number().over(W.partitionBy("q").orderBy(F.col("low").desc())).alias("r")).where(F.col("r") <= top)
    bar = best.groupBy("q").agg(F.when(F.count("*") == top, F.min("low")).alias("bar"))
    return found.join(bar, "q").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).drop("bar")


def search(docs: DataFrame, items: DataFrame, index: Index | None = None, top: int = TOP, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(``item``, rank, ``key``, score): the ``top`` documents of each item with the highest scores above 0.

    A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), its share of a document's score w * (10^9 tf div (1000 tf + 20 m)) with
    m = 50 + 50 n N div L; df, N (documents with terms) and L (tokens) count all rows. Equal scores stand by ascending key, null keys last, and
    repeated rows are documents of their own. Null and empty texts match nothing; items without terms, or whose terms no document has, have no
    rows; repeated item rows are each answered. Without documents or items the result is empty. ``index``, if given, is one of ``docs``.
    """
    own = index is None
    index = build(docs, text, key) if own else index
    rows = saved(items.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn("q", F.monotonically_increasing_id()), "search-items")
    terms = saved(rows.select("q", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")), "search-terms")
    held = _sized(saved(terms.select("term").distinct(), "search-distinct"), "term")
    df = index.lists.select("term", "df").join(held, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * index.documents + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("long")
    asked = saved(terms.join(df, "term").select("q", "term", weight.alias("w")).where("w > 0"), "search-weights")
    some = saved(candidates(index, asked, top), "search-candidates")
    # the exact level of the documents that are left
    picked = _sized(saved(some.select("block", "at").distinct(), "search-picked"))
    exact = index.forward.join(picked, ["block", "at"], "left_semi").withColumn("m", F.lit(50) + F.expr(f"(50 * n * {index.documents}L) div {max(1, index.tokens)}L"))
    exact = exact.select("block", "at", "h", "h2", "first", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("block", "at", "h", "h2", "first", "m", F.col("t.terms").alias("term"), F.col("t.tfs").cast("long").alias("tf"))
    exact = saved(exact.join(held, "term", "left_semi"), "search-exact")
    share = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    scored = some.select("q", "block", "at").join(asked, "q").join(exact, ["block", "at", "term"]).groupBy("q", "h", "h2", "first").agg(F.sum(share).alias("score")).where("score > 0")
    best = lambda first: W.partitionBy("q").orderBy(F.col("score").desc(), F.col(first).asc_nulls_last())
    hits = saved(scored.withColumn("r", F.row_number().over(best("first"))).where(F.col("r") <= top).drop("r", "first"), "search-hits")
    # of a text's copies the first ones are enough; the limit is applied before rows are dealt
    copies = docs.select(*_hashes(text), F.col(key).alias("doc")).join(_sized(saved(hits.select("h", "h2").distinct(), "search-classes")), ["h", "h2"], "left_semi")
    nth = F.row_number().over(W.partitionBy("h", "h2").orderBy(F.col("doc").asc_nulls_last()))
    copies = copies.withColumn("r", nth).where(F.col("r") <= top).drop("r")
    out = hits.join(copies, ["h", "h2"]).withColumn("rank", F.row_number().over(best("doc"))).where(F.col("rank") <= top)
    out = out.join(rows.select("q", "item"), "q").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
    drop(some, exact, *([index.lists, index.forward] if own else []))
    return out
