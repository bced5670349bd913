"""Watching a folder: new files are ingested as they come, each batch as one snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexatlas.sources.files import SUFFIXES, suffix

_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, ingest: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream over the files of ``path``; ``ingest`` gets (path, content, sha256) of each batch's new files.

    The checkpoint remembers what has been seen. A batch may be given twice after a failure; an ingest that refuses
    known bytes, or replaces them, makes that harmless.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).load(path)
    known = files.where(suffix(F.col("path")).isin(*SUFFIXES)).select("path", "content", F.sha2("content", 256).alias("sha256"))

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            ingest(df)

    writer = known.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
