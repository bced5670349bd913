"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before kept, read from Parquet.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm import decontamination, jaccard_join, line_dedup, mixing, quality
from lexatlas.llm._work import drop, saved


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good and not toxic; the others go. Labels come from the table beside.

    Null and empty texts are judged as empty ones, null ids have no label, repeated rows are judged alike, an empty table stays
    empty, and other columns, whatever their names, come through."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("keep").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; n_chars follows. A document none of whose lines is left goes,
    unless it was blank before. Null texts stay as they are, null ids stand last, and repeated rows lose the same lines."""
    out = line_dedup.dedup_lines(docs, shortest=line_dedup.LEAST, exact=line_dedup.EXACT)
    whole = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return whole.withColumn("n_chars", chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the one with the smallest id, null ids last, then
    the smallest hash of its text. Of repeated rows one stays too. Rows without words are in no group and stay."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    # its fields may be null to Arrow
    row = row.cast(f"struct<none:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},th:bigint>")
    classes = saved(jaccard_join.jaccard_components(docs.select(row.alias("row"), "text"), 5, 80, key="row"), "classes")
    first = F.col("row") == F.col("component_id")
    gone = classes.where(~first).select("row").distinct()
    # rows that agree in id and text stand for their group more than once
    several = classes.where(first & (F.col("n_shingles") > 0)).groupBy("row").count().where("count > 1").select("row")
    gone, several = saved(gone, "duplicates"), saved(several, "repeated")
    drop(classes)
    rows = docs.select(row.alias("row"), F.struct(*docs.columns).alias("d"))
    one = rows.join(several, "row", "left_semi").groupBy("row").agg(F.min("d").alias("d"))
    rest = rows.join(gone.unionByName(several), "row", "left_anti")
    return rest.unionByName(one).select("d.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, edited or not, of a benchmark item. Null and empty texts hold none and stay; a row goes by
    its own text, so rows with one id are judged apart; without items, or without documents, nothing goes."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents repeated to their source's target, with ``copy`` from 1. A null source is one of its own;
    null texts have no words but are taken at their source's rate; a column named copy is replaced."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: A trained classifier, edit distances and alignments have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k + 1}")
    return docs
