"""Continuous ingest of image files (an extension; batches are the engine's own form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import MAX_UPLOAD, content_id, extension


def stream_files(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1_000) -> DataFrame:
    """Files that appear in a folder: id, name, ext, size_bytes, seen_at, content."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    files = files.where((F.col("length") > 0) & (F.col("length") <= MAX_UPLOAD))
    return files.select(content_id(F.col("content")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("seen_at"), "content")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, lateness: str = "1 day"):
    """Start a query that appends each content once; state is dropped once a content is older than ``lateness``."""
    fresh = stream_files(spark, path).withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["id"])
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
