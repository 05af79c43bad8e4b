"""Streams over folders that grow: new page images, and index updates when documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import LibraryIndex
from ..sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_images(spark: SparkSession, pattern: str) -> DataFrame:
    """A stream of (session, path, content) of page images that appear in session folders."""
    found = spark.readStream.schema(BINARY).format("binaryFile").load(pattern)
    return found.where(files.suffix(F.col("path")).isin(*files.FOLDER_IMAGES)).select(files._name(F.col("path"), 1).alias("session"), "path", "content")


def keep_index(spark: SparkSession, root: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Update the index whenever a meta.json arrives or changes its file; batches without news cost nothing."""
    index = LibraryIndex(spark, root, path)
    seen = spark.readStream.schema(BINARY).format("binaryFile").option("pathGlobFilter", "meta.json").load(f"{root.rstrip('/')}/*/")
    writer = seen.select("path", "modificationTime").writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: None if df.isEmpty() else index.update() and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
