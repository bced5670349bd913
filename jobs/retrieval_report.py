"""Retrieval report: do searches made from known documents find them?

Every document whose id is a multiple of ``every`` asks with its first search terms, all questions in one job, and each mode's
ranks are written to its own partition, ``mode=<mode>``, by dynamic partition overwrite. A rerun replaces them with the same rows; a mode that
the config no longer names keeps what it had. The summary by language goes to the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lexatlas.operators import batch, evaluate
from lexatlas.work import settled

SCHEMA = "question long, tag string, rank int, id long, places long, expected boolean, mode string"
DEFAULTS = {"modes": ["strict", "any", "both"], "k": 10, "terms": 12, "every": 100}


def ranks(docs: DataFrame, settings: dict) -> DataFrame:
    """One row per mode, question and hit, and one without a rank for a question that has no hit in a mode.

    Null texts hold no terms; a null id asks nothing. Rows with one id are hits of their own, as often as they stand.
    """
    asking = docs.where((F.col("doc_id") % settings["every"]) == 0).select(F.col("doc_id").alias("question"), "text", F.coalesce("lang", F.lit("")).alias("tag"))
    found = settled(batch.lexical_top(docs, batch.question_terms(asking, most=settings["terms"]), settings["k"], tuple(settings["modes"]), "doc_id"))
    out = None
    for mode in settings["modes"]:
        hits = found.where(F.col("mode") == mode).drop("mode")
        of = asking.select("question", "tag").distinct().join(hits, "question", "left")
        row = of.select("question", "tag", "rank", "id", "places", F.coalesce(F.col("id") == F.col("question"), F.lit(False)).alias("expected"), F.lit(mode).alias("mode"))
        out = row if out is None else out.unionByName(row)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """(mode, tag, n, metrics) over the written ranks, by the library's own scoring."""
    none = F.array().cast("array<string>")
    text = lambda c: F.col(c).cast("string")
    hits = rows.select("mode", text("question").alias("id"), F.coalesce("rank", F.lit(1_000_000)).alias("rank"), text("id").alias("number"), none.alias("kinds"), F.col("rank").isNull().alias("abstain"))
    questions = rows.select("question", "tag").distinct().select(text("question").alias("id"), F.array(text("question")).alias("expected_sections"), none.alias("expected_kinds"), F.array("tag").alias("tags"))
    return evaluate.summarize(evaluate.score(hits, questions))


def run(spark: SparkSession, source: str, out: str, settings: dict | None = None) -> DataFrame:
    """Rank all questions over ``source``, a Parquet table of documents, write ``out`` and log the summary; what was written."""
    settings = DEFAULTS | (settings or {})
    docs = spark.read.parquet(source).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    ranks(docs, settings).hint("rebalance", "mode").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(out)
    written = spark.read.schema(SCHEMA).parquet(out)
    got = written.where(F.col("mode").isin(settings["modes"])).agg(F.count("*").alias("rows"), F.countDistinct("question").alias("questions")).first()
    log.info("read %d documents of %s; wrote %d rows for %d questions in %d modes to %s", docs.count(), source, got["rows"], got["questions"], len(settings["modes"]), out)
    log.info("summary\n%s", evaluate.report(summary(written)))
    return written


if __name__ == "__main__":
    command("retrieval_report", lambda spark, settings, at: run(spark, at["source"], at["out"], settings), {"source": "Parquet table of documents", "out": "table of ranks"})
