"""The append-only log of answers as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.session import new_path


def first_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Each request (id and fingerprint) once, as the log's files arrive: what a resumed run need not ask again.

    The stream takes all files that are there and ends. The state is one key a request and is kept without a
    watermark, since rows may be late by any time and none may be dropped; null keys count as one key.
    """
    schema = spark.read.parquet(folder).schema
    log = spark.readStream.schema(schema).format("parquet").load(folder[:-1] + f"[{folder[-1]}]")  # a pattern, as a stream takes no single file by name
    once = log.where("hata IS NULL").select("id", "istek_sha256", "model").dropDuplicates(["id", "istek_sha256", "model"])
    out = new_path(spark, "requests")
    query = once.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(out)
