"""Shared folders, block sizes and small plan helpers of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_made: dict[str, DataFrame] = {}


@atexit.register
def _tidy() -> None:
    """Delete what is left when the process ends; tables that a result still reads stay until then."""
    for t in list(_made.values()):
        with contextlib.suppress(Exception):
            drop(t)


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one only where that is unset and all
    runs on this machine. On a cluster its executors would write to disks of their own, so there an unset folder is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexatlas-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    The shuffle files of the write are dropped at its end where Spark offers that.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _made[path] = out
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`saved` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            _made.pop(path, None)


def blocks_of(docs: DataFrame, text: str, each: int) -> int:
    """Number of blocks of about ``each`` bytes of text; follows the input, 4 at least. One cheap pass measures it."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(4, -(-int(size) // each))


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
