"""Structured Streaming over the same operators as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.formats import format_of_bytes, format_of_path
from rasterlake.sources.files import decode_frames

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, detect_by: str = "extension", per_trigger: int = 1000) -> DataFrame:
    """New files under path as they arrive, with their format."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    kind = format_of_bytes(F.col("content")) if detect_by == "content" else format_of_path(F.col("path"))
    return files.withColumn("format", kind)


def stream_frames(spark: SparkSession, path: str, detect_by: str = "extension") -> DataFrame:
    return decode_frames(stream_files(spark, path, detect_by))


def arrivals(files: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by format and window of their modification time; later ones than the watermark are left out."""
    seen = files.withWatermark("modificationTime", late)
    return seen.groupBy(F.window("modificationTime", width), "format").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
