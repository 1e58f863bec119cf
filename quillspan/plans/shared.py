"""Relations that several queries start from, each with the same relation as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.ranking import latest_score, ranked
from quillspan.sources.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, doc, page, n_words, text): repeated rows once, a null doc read from the id."""
    c = table(spark, d, "chunks", "chunk_id", "doc", "sayfa_idx", "kelime", "metin").where("chunk_id IS NOT NULL").groupBy("chunk_id")
    c = c.agg(F.min("doc").alias("doc"), F.min("sayfa_idx").alias("page"), F.max("kelime").alias("n_words"), F.max("metin").alias("text"))
    return c.withColumn("doc", F.coalesce("doc", F.substring_index("chunk_id", "#", 1)))


CHUNKS = """chunk AS (SELECT chunk_id, coalesce(min(doc), split_part(chunk_id, '#', 1)) AS doc, min(sayfa_idx) AS page,
  max(kelime) AS n_words, max(metin) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(qid, kayit_no, doc, question, answer, evidence): the first record of each id."""
    q = table(spark, d, "sorular", "financebench_id", "kayit_no", "doc_name", "question", "answer", "question_type", "evidence").where("financebench_id IS NOT NULL")
    first = F.min_by(F.struct(F.col("kayit_no"), F.col("doc_name").alias("doc"), "question", "answer", "question_type", "evidence"), "kayit_no").alias("r")
    return q.groupBy(F.col("financebench_id").alias("qid")).agg(first).select("qid", "r.*")


QUESTIONS = """q AS (SELECT financebench_id AS qid, kayit_no, doc_name AS doc, question, answer, question_type, evidence FROM sorular
  WHERE financebench_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY financebench_id ORDER BY kayit_no) = 1)"""


def company(doc: Column, qid: Column) -> Column:
    """What stands before the first low line of the document's name (of the question's, where no document is given)."""
    return F.upper(F.substring_index(F.coalesce(doc, qid), "_", 1))


def locked(company: Column) -> Column:
    """Whether a company belongs to the held-out third: by a hash of its name, so nothing is sorted or stored to split them."""
    return F.substring(F.md5(F.concat_ws("|", F.lit("locked"), company)), 1, 4) < "5555"


LOCKED = "left(md5(concat_ws('|', 'locked', upper(split_part(coalesce(doc, {0}), '_', 1)))), 4) < '5555'"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(qid, ev, doc, page, text): every evidence row counts, also the same page twice."""
    e = questions(spark, d).select("qid", F.posexplode("evidence").alias("ev", "e"))
    return e.select("qid", "ev", F.col("e.doc_name").alias("doc"), F.col("e.evidence_page_num").alias("page"), F.col("e.evidence_text").alias("text"))


EVIDENCE = (
    QUESTIONS
    + """, ev AS (SELECT qid, (i - 1)::INT AS ev, evidence[i].doc_name AS doc, evidence[i].evidence_page_num AS page, evidence[i].evidence_text AS text
  FROM q, unnest(range(1, coalesce(len(evidence), 0) + 1)) AS u(i))"""
)


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(qid, chunk_id, score): the finite score of the latest time."""
    s = table(spark, d, "skorlar", "soru_id", "chunk_id", "skor", "yazildi")
    return latest_score(s, ["soru_id", "chunk_id"], "skor", "yazildi").select(F.col("soru_id").alias("qid"), "chunk_id", F.col("skor").alias("score"))


SCORES = """score AS (SELECT soru_id AS qid, chunk_id, skor AS score FROM skorlar WHERE isfinite(skor) AND soru_id IS NOT NULL AND chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY soru_id, chunk_id ORDER BY yazildi DESC NULLS LAST, skor DESC) = 1)"""


def ranking(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best scored chunks of each question."""
    return ranked(scores(spark, d), ["qid"], [F.desc("score"), F.asc("chunk_id")], k)


RANKING = (
    SCORES
    + """, ranking AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM score) WHERE rank <= 100)"""
)


def first_seen(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """A second ranking of the same questions: by the best score a chunk ever had."""
    s = table(spark, d, "skorlar", "soru_id", "chunk_id", "skor").where("soru_id IS NOT NULL AND chunk_id IS NOT NULL AND skor IS NOT NULL AND NOT isnan(skor) AND abs(skor) < double('infinity')")
    best = s.groupBy(F.col("soru_id").alias("qid"), "chunk_id").agg(F.max("skor").alias("score"))
    return ranked(best, ["qid"], [F.desc("score"), F.desc("chunk_id")], k)


FIRST_SEEN = """best AS (SELECT soru_id AS qid, chunk_id, max(skor) AS score FROM skorlar WHERE isfinite(skor) AND soru_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
  other AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM best) WHERE rank <= 100)"""

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def sql_ngrams(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE [] END"
