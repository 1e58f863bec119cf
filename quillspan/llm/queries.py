"""The registered queries of this subpackage, and their SQL where DuckDB can state them over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bytebpe, defects, leakage, packing, quality, splits, topgroups
from quillspan.session import written
from quillspan.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scores, chunks = table(spark, d, "skorlar", "soru_id", "chunk_id", "skor", "yazildi"), table(spark, d, "chunks", "chunk_id", "doc")
    return topgroups.best_chunks(scores, chunks).select("soru_id", "doc", "chunk_id")


#: The same by one window over all rows.
P1_FOUND = """
WITH finite_rows AS (SELECT * FROM skorlar WHERE isfinite(skor) AND soru_id IS NOT NULL AND chunk_id IS NOT NULL),
once AS (SELECT soru_id, chunk_id, skor FROM finite_rows
         QUALIFY row_number() OVER (PARTITION BY soru_id, chunk_id ORDER BY yazildi DESC NULLS LAST, skor DESC) = 1),
known AS (SELECT chunk_id, coalesce(min(doc), split_part(chunk_id, '#', 1)) AS doc FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT soru_id, doc, chunk_id FROM once JOIN known USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY soru_id, doc ORDER BY skor DESC, chunk_id) <= 5
"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return defects.tagged(table(spark, d, "cevaplar", "kayit_no", "id", "yanit"), table(spark, d, "sorular", "financebench_id", "question"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where("kusur IS NOT NULL").select("kayit_no", "kusur")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.question_groups(table(spark, d, "sorular", "kayit_no", "financebench_id", "doc_name"))


#: Components by spreading the smallest name along links until nothing changes.
P4_FOUND = r"""
WITH RECURSIVE named AS (
  SELECT kayit_no, nullif(regexp_replace(lower(financebench_id), '[^a-z0-9]', '', 'g'), '') AS id,
         nullif(regexp_replace(regexp_replace(lower(doc_name), '\.pdf\s*$', ''), '[^a-z0-9]', '', 'g'), '') AS doc FROM sorular),
links AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT DISTINCT id, doc FROM named) x JOIN (SELECT DISTINCT id, doc FROM named) y USING (doc)),
reach AS (SELECT DISTINCT id AS a, id AS b FROM named UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
first AS (SELECT a AS id, min(b) AS name FROM reach GROUP BY a)
SELECT kayit_no, 'financebench_id_' || right(name, 8) AS grup FROM named JOIN first USING (id)
"""


def p4_parts(spark: SparkSession, d: str) -> DataFrame:
    return splits.question_parts(table(spark, d, "sorular", "kayit_no", "financebench_id", "doc_name"), {"egitim": 0.8, "dogrulama": 0.1, "sinama": 0.1})


def _leaks(spark: SparkSession, d: str, short: int | None) -> DataFrame:
    texts = leakage.training_texts(table(spark, d, "finqa", "id", "pre_text", "tablo", "post_text"), table(spark, d, "documents", "doc_id", "text"))
    return leakage.leaks(table(spark, d, "kilitli_kanit", "fb_soru", "metin"), texts, short=short)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(_leaks(spark, d, None))


def p5_rapor(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, leakage.SHORT)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytebpe.encode_corpus(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents", "doc_id", "source", "text"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far runs of 1 to 64 windows are from the sources' shares, by round: the mean total variation, weighed by tokens."""
    placed = packing.packed(table(spark, d, "documents", "doc_id", "source", "text"), 4096, None, 0.97, None)
    placed = written(placed.select("round", "shard", "window", "source", "n_tokens", "share"), "placed")
    parts = [packing.mixture(placed, n).groupBy("round").agg(F.count(F.lit(1)).alias("runs"), (F.sum(F.col("distance") * F.col("tokens")) / F.sum("tokens")).alias("distance")).withColumn("windows", F.lit(n)) for n in (1, 4, 16, 64)]
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "tur")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.measured(table(spark, d, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_coverage, p4_found, p4_parts, p5_found, p5_rapor, p6_ids, p7_containers, p7_mixture, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p4_found": P4_FOUND}
