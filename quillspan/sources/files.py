"""Scans of files that carry part of their data in their path or their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_lines(spark: SparkSession, pattern: str, schema: str, key: str, of_path: str) -> DataFrame:
    """JSON lines of all files that ``pattern`` matches, with ``key`` read from each file's path by the first group of ``of_path``."""
    path = F.regexp_extract(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), of_path, 1)
    return spark.read.schema(schema).json(pattern).select("*", path.alias(key))


def whole_json(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of files that are each one JSON array or document."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def file_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, n_bytes, sha256) of the files that ``pattern`` matches, read as bytes."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
