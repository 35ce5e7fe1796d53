"""Readers of PDF files as binary rows, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_id"), F.col("length").alias("byte_size"), "modificationTime", "content")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, byte_size, modificationTime, content`` of the PDF files below ``path``."""
    return _rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path))


def stream_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """The same for files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _rows(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path))
