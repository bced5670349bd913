"""Chunk feed: new files of a growing table of documents become chunks that a search can load.

A file stream takes what has come since the last run and ends (``availableNow``); its checkpoint is the only memory. Each batch is
written into partitions of its own, ``batch=<id>/corpus=<corpus>``, by dynamic partition overwrite, so a batch that is run again
after a failure replaces what it left. A document that comes again in a later batch supersedes its older chunks when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lexatlas.functions import lexical
from lexatlas.operators import chunking

SCHEMA = "doc_id long, window int, n_tokens int, n_terms int, sha256 string, text string, batch long, corpus string"
#: Settings that the config file gives, with what holds without it.
DEFAULTS = {"window": 512, "corpus": "source", "files_per_batch": 0}


def chunked(docs: DataFrame, window: int, corpus: str) -> DataFrame:
    """One row per window of each document's text, with its tokens, its terms that aren't stop words, and its hash.

    All happens within a document's row. A null, empty or blank text has one row without a window, which says that the document
    has no chunks from now on. A null corpus is one of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(corpus).cast("string").alias("corpus"), F.explode_outer(chunking.fixed_windows(F.col("text"), window)).alias("c"))
    terms = F.when(F.col("c.text").isNotNull(), F.size(F.array_compact(lexical.terms(F.col("c.text")))))
    return rows.select("doc_id", "c.window", "c.n_tokens", terms.alias("n_terms"), F.sha2("c.text", 256).alias("sha256"), "c.text", "corpus")


def write_batch(docs: DataFrame, batch: int, out: str, settings: dict) -> None:
    """The chunks of one batch into its partitions. Rows are dealt evenly within a corpus, so a large one has several files."""
    made = chunked(docs, settings["window"], settings["corpus"]).withColumn("batch", F.lit(batch).cast("long"))
    made.hint("rebalance", "corpus").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "corpus").parquet(out)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Take what is new under ``source``, a Parquet table of documents (a folder or a glob); {batches, documents, chunks} of this run.

    Columns are those of the files that are there. A run without new files writes nothing. Files are known by path, and a file
    is taken whatever its age: one that comes late with an old time of change isn't passed over.
    """
    settings = DEFAULTS | (settings or {})
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFileAge", "36500d")
    if settings["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", settings["files_per_batch"])
    taken: list[int] = []

    def batch(docs: DataFrame, number: int) -> None:
        write_batch(docs, number, out, settings)
        taken.append(number)

    stream.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = {"batches": len(taken), "documents": 0, "chunks": 0}
    if taken:
        wrote = spark.read.schema(SCHEMA).parquet(out).where(F.col("batch").isin(taken))
        row = wrote.agg(F.count(F.when(F.coalesce("window", F.lit(0)) == 0, 1)).alias("documents"), F.count("window").alias("chunks")).first()
        done |= row.asDict()
    log.info("read %d new documents of %s in %d batches; wrote %d chunks to %s", done["documents"], source, done["batches"], done["chunks"], out)
    return done


def current(spark: SparkSession, out: str) -> DataFrame:
    """All chunks, each document's from the latest batch that has the document; those without an id are never superseded."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    # one number for each document meets its chunks, and only those that stand in several batches are judged
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).where("first < last").select("doc_id", "last")
    latest = rows.join(several, "doc_id", "left").where(F.col("last").isNull() | (F.col("batch") == F.col("last")))
    return latest.where("window is not null").drop("last", "batch")


if __name__ == "__main__":
    command("chunk_feed", lambda spark, settings, at: run(spark, at["source"], at["out"], at["checkpoint"], settings), {"source": "Parquet table of documents", "out": "table of chunks", "checkpoint": "the stream's memory"})
