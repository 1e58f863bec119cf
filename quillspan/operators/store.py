"""Tables kept under a path, built once and checked by their number of rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def ensured(rows: DataFrame, path: str, *partition_by: str) -> bool:
    """Whether the table at ``path`` had to be built: not if it is there with as many rows as ``rows`` has; a table with another
    number is written anew. ``rows`` must not read from ``path``."""
    try:
        there = rows.sparkSession.read.parquet(path).count()
    except AnalysisException:  # no such table yet
        there = -1
    if there == rows.count():
        return False
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return True
