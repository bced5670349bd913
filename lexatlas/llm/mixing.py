"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._work import saved, words_in

#: Fixed values of the production mix: weights of the sources in code-point order, repeating; most repeats of a source.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Rows and bytes of source names up to which the table of rates is broadcast; shares that a source is dealt into beyond.
SMALL, SMALL_BYTES, SHARES = 100_000, 16 << 20, 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> plus weight, target.

    Sources share the total of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared again among the others by weight, until none is above. Sorted by cap per weight, the capped
    sources are a prefix, so running sums give the answer without a loop: with C and V the caps and weights of the
    sources before it, a source is capped when cap * (sum of weights - V) <= weight * (total - C). All sums are whole
    numbers, so the result doesn't depend on the order of rows. The table has one row per source (a null source is
    one, ordered last); only this table, never the documents, passes through one task.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("long"))
    whole = W.partitionBy()
    up = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(38,0)")
    s = s.withColumns({"all_w": F.sum("weight").over(whole), "all_s": F.sum("source_size").over(whole), "v": F.coalesce(F.sum("weight").over(up), F.lit(0)), "c": F.coalesce(F.sum("cap").over(up), F.lit(0))})
    capped = big(F.col("cap")) * big(F.col("all_w") - F.col("v")) <= big(F.col("weight")) * big(F.col("all_s") - F.col("c"))
    s = s.withColumn("capped", capped)
    s = s.withColumns({"left": F.col("all_s") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0)), "free": F.col("all_w") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(whole), F.lit(0))})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("free"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` joined with ``rates`` by ``of``, a struct of the source, without dealing rows by source.

    The table of rates is written, counted, and broadcast while it is small. Beyond that the rows of a source are dealt
    by source and a share of their own, drawn from ``u``, and each rate goes to all shares.
    """
    rates = saved(rates, "mix-rates")
    n, size = rates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("of.source")), F.lit(0))).first()
    if n <= SMALL and size <= SMALL_BYTES:
        return rows.join(F.broadcast(rates), "of")
    shared = rates.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("share", F.floor(F.col("u") * SHARES).cast("int")).join(shared, ["of", "share"]).drop("share")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, source, size (words), source_size, target, rate and copies.

    A document of a source with rate r = target / source_size is taken floor(r) times, and once more when its own
    hash falls below r - floor(r), so ``copies`` never exceeds ``most`` and reruns agree. Null text: size 0. A null
    source is a source of its own; a source without words has rate 0. A null key draws the number of the empty key.
    Rows are never dropped and repeated rows are each planned. The per-source sums are combined before their shuffle,
    and rates come back by :func:`with_rates`, so no row is dealt by its source alone. An empty table gives an empty one.
    """
    sized = docs.select(F.col(key), F.struct("source").alias("of"), words_in(F.col("text")).alias("size"), uniform(F.col(key), seed).alias("u"))
    sources = source_targets(sized.groupBy("of.source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    planned = with_rates(sized, sources.select(F.struct("source").alias("of"), "source_size", "target", rate.alias("rate")))
    extra = F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return planned.select(key, "of.source", "size", "source_size", "target", "rate", (F.floor("rate") + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """The mixed corpus: every row of ``docs`` emitted ``copies`` times, with ``copy`` (1, 2, ...).

    The rates are those of :func:`mix_plan`. While the table of sources is small, texts aren't shuffled at all. Null
    texts, and documents without words, are taken as often as their source's rate says. Columns of
    ``docs`` are kept as they are; any named ``copy`` is replaced. An empty table gives an empty table.
    """
    sizes = docs.select(F.col("source"), words_in(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rates = sources.select(F.struct("source").alias("of"), rate.alias("rate"))
    kept = [c for c in docs.columns if c != "copy"]
    # the row travels as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*kept).alias("d"), F.struct("source").alias("of"), uniform(F.col(key), seed).alias("u"))
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    planned = with_rates(rows, rates).withColumn("n", copies.cast("int")).where("n > 0")
    return planned.select(*[F.col("d").getField(c).alias(c) for c in kept], F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
