"""Queries on texts, chunks, search and rankings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import ann, chunking, dense, lexical, ranking, store
from quillspan.plans import shared as S
from quillspan.session import new_path, written
from quillspan.sources import files
from quillspan.sources.tables import table


def document_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return t.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("fingerprint"))


def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sorular", "doc_name").where("doc_name IS NOT NULL").distinct().orderBy("doc_name")


def parse_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    t = table(spark, d, "documents", "doc_name", "text").where("doc_name IS NOT NULL").groupBy("doc_name")
    return t.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.when(n < 20, 1).otherwise(0)).alias("empty_pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read again with an explicit schema."""
    path = new_path(spark, "jsonl")
    S.chunks(spark, d).write.json(path)
    back = spark.read.schema("chunk_id string, doc string, page int, n_words int, text string").json(path)
    return back.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("total_words"), F.sum(F.length("text")).alias("total_chars"))


def files_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON lines, one folder a document, and read by a pattern with the document taken from the path; and the bytes
    of the files themselves."""
    path = new_path(spark, "pages")
    pages = table(spark, d, "documents", "doc_name", "sayfa_idx", "text").where("doc_name IS NOT NULL AND trim(doc_name) <> ''").withColumn("doc", F.md5("doc_name"))
    pages.write.partitionBy("doc").json(path)
    back = files.keyed_lines(spark, f"{path}/doc=*/*.json", "doc_name string, sayfa_idx int, text string", "key", r"doc=([^/]*)/").groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    sizes = files.file_manifest(spark, f"{path}/doc=*/*.json").groupBy(F.regexp_extract("path", r"doc=([^/]*)/", 1).alias("key")).agg((F.sum("n_bytes") > 0).alias("filled"))
    return back.join(sizes, "key")


def whole_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The items of each document written as one JSON array a line, read again as whole documents."""
    path = new_path(spark, "whole")
    rows = table(spark, d, "kilitli_kanit", "fb_soru", "fb_belge", "fb_sayfa").groupBy("fb_belge").agg(F.to_json(F.array_sort(F.collect_list(F.struct("fb_soru", "fb_belge", "fb_sayfa")))).alias("value"))
    rows.select("value", F.md5(F.coalesce("fb_belge", F.lit(""))).alias("doc")).repartition("doc").write.partitionBy("doc").text(path)
    back = files.whole_json(spark, f"{path}/doc=*/*.txt", "fb_soru string, fb_belge string, fb_sayfa int")
    return back.groupBy("fb_belge").agg(F.count(F.lit(1)).alias("n"), F.sum("fb_sayfa").alias("pages"))


def variant_store(spark: SparkSession, d: str) -> DataFrame:
    """The windows of all variants in one table by variant, and how many windows and words each holds."""
    pages = table(spark, d, "documents", "doc_id", "text")
    parts = [chunking.chunked(pages, "doc_id", "text", size, overlap).withColumn("variant", F.lit(v)) for v, (size, overlap) in chunking.VARIANTS.items()]
    kept = written(reduce(DataFrame.unionByName, parts), "variants", ["variant"])
    return kept.groupBy("variant").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_words").alias("words"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = S.chunks(spark, d).where("text IS NOT NULL")
    return t.select("chunk_id", F.size(T.words(F.col("text"))).alias("n_words"), F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.round(T.digit_share(F.col("text")), 6).alias("digits"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    t = S.chunks(spark, d).where("text IS NOT NULL").select("chunk_id", F.array_distinct(T.ngrams(T.tokens(F.col("text")), 5)).alias("s"))
    return t.select("chunk_id", F.size("s").alias("n_shingles"))


def word_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Words of chunks by document: mean, median, the 95th percentile by interpolation and by lower rank, maximum."""
    t = S.chunks(spark, d).where("text IS NOT NULL").groupBy("doc", F.size(T.words(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("times"))
    # One row for each number of words of a document: ranks are running sums, whatever number of chunks a document has.
    upto = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("upto", F.sum("times").over(upto)).withColumn("all", F.sum("times").over(Window.partitionBy("doc")))
    low = F.min(F.when(F.col("upto") > F.floor(F.lit(0.95) * (F.col("all") - 1)), F.col("n"))).alias("p95_low")
    point = lambda p: F.round(F.percentile("n", F.lit(p), F.col("times")), 6)
    return t.groupBy("doc").agg(F.round(F.sum(F.col("n") * F.col("times")) / F.sum("times"), 6).alias("mean"), point(0.5).alias("median"), point(0.95).alias("p95"), low, F.max("n").alias("most"))


#: The longest inputs of common embedding models.
INPUT_LIMITS = (512, 8192)


def chunk_length_audit(spark: SparkSession, d: str) -> DataFrame:
    """Words of chunks against the longest inputs of embedding models: median and 99th percentile (cut to whole words), maximum, and
    how many chunks are longer. Chunks are counted by their number of words first."""
    t = S.chunks(spark, d).where("text IS NOT NULL").groupBy(F.size(T.words(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("times"))
    t = t.withColumn("most", F.explode(F.array(*map(F.lit, INPUT_LIMITS))))
    point = lambda p: F.floor(F.round(F.percentile("n", F.lit(p), F.col("times")), 6)).cast("int")
    over = F.sum(F.when(F.col("n") > F.col("most"), F.col("times")).otherwise(0))
    return t.groupBy("most").agg(F.sum("times").alias("chunks"), point(0.5).alias("median"), point(0.99).alias("p99"), F.max("n").alias("longest"), over.alias("over"), F.round(over / F.sum("times"), 6).alias("share"))


def document_labels(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "belgeler", "doc_name", "company", "doc_type", "doc_period").where("doc_name IS NOT NULL").distinct()
    label = T.document_label(F.col("company"), F.col("doc_name"), F.col("doc_type"), F.col("doc_period"))
    return b.select("doc_name", label.alias("label"))


_chunk_queries = {}
for _name, (_size, _overlap) in chunking.VARIANTS.items():

    def _windows(spark: SparkSession, d: str, size: int = _size, overlap: int = _overlap) -> DataFrame:
        c = chunking.chunked(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", size, overlap)
        return c.select("doc_id", "k", "n_words", F.md5("body").alias("body_md5"))

    _chunk_queries[f"chunk_{_name}"] = _windows


def chunk_variant_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of windows and words of each variant; the pages are split once, windows are counted by arithmetic."""
    n = table(spark, d, "documents", "text").select(F.size(T.words(F.col("text"))).alias("n")).where("n > 0")
    parts = [F.struct(F.lit(v).alias("variant"), F.lit(s).alias("size"), F.lit(o).alias("overlap")) for v, (s, o) in chunking.VARIANTS.items()]
    spread = n.select("n", F.explode(F.array(*parts)).alias("v")).select("n", "v.*")
    windows = F.floor(F.greatest(F.col("n") - F.col("overlap") - 1, F.lit(0)) / (F.col("size") - F.col("overlap"))) + 1
    return spread.groupBy("variant").agg(F.sum(windows).cast("bigint").alias("chunks"), F.sum(F.col("n") + F.col("overlap") * (windows - 1)).cast("bigint").alias("words"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    texts = S.chunks(spark, d).where("text IS NOT NULL")
    n = texts.where(F.size(T.tokens(F.col("text"))) > 0).count()
    return lexical.idf(lexical.postings(texts, ["chunk_id"], "text"), n).select("term", "df", F.round("idf", 6).alias("idf"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: records whose number is divisible by 50."""
    return table(spark, d, "sorular", "kayit_no", "doc_name", "question").where("kayit_no % 50 = 0 AND question IS NOT NULL").select(F.col("kayit_no").alias("query"), F.col("doc_name").alias("doc"), "question")


def bm25_pooled_top10(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_asked(spark, d).drop("doc"), S.chunks(spark, d).where("text IS NOT NULL"))


def bm25_single_top10(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_asked(spark, d).where("doc IS NOT NULL"), S.chunks(spark, d).where("text IS NOT NULL"), within="doc")


def bm25_labelled_top10(spark: SparkSession, d: str) -> DataFrame:
    """The pooled search over texts that carry the label of their document; the label is part of the indexed text only."""
    labels = document_labels(spark, d).groupBy(F.col("doc_name").alias("doc")).agg(F.min("label").alias("label"))
    texts = S.chunks(spark, d).where("text IS NOT NULL").join(labels, "doc", "left").select("chunk_id", F.concat_ws(" ", "label", "text").alias("text"))
    return lexical.bm25(_asked(spark, d).drop("doc"), texts)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding", "label"), v


def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    queries, corpus = _vectors(spark, d)
    return dense.search(queries, corpus, 10).select("query", "vec_id", "rank", F.round("score", 5).alias("score"))


def dense_filtered_top10(spark: SparkSession, d: str) -> DataFrame:
    queries, corpus = _vectors(spark, d)
    return dense.search(queries, corpus, 10, same="label").select("query", "vec_id", "rank", F.round("score", 5).alias("score"))


#: The share of the cells that a query looks into. These vectors are nearly random, so near ones lie in most cells.
PROBED = 0.6


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    queries, corpus = _vectors(spark, d)
    centres = ann.centroids(corpus)
    return queries, corpus, ann.indexed(corpus, centres), centres


def ann_top10(spark: SparkSession, d: str) -> DataFrame:
    queries, _, index, centres = _index(spark, d)
    found = ann.search(queries, index, centres, 10, max(1, round(PROBED * len(centres))))
    return found.select("query", "vec_id", "rank", F.round("score", 5).alias("score"))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against the exact search, and the share of all pairs that are compared, for several shares of probed cells."""
    queries, corpus, index, centres = _index(spark, d)
    exact = written(dense.search(queries, corpus, 10), "exact")
    pairs = queries.where("embedding IS NOT NULL").count() * index.count()
    parts = []
    for share in (0.1, 0.25, 0.5, PROBED):
        probes = max(1, round(share * len(centres)))
        hit = ann.recall(exact, ann.search(queries, index, centres, 10, probes), 10).agg(F.sum("shared").alias("shared"), F.sum("size").alias("size"))
        looked = ann.compared(queries, index, centres, probes)
        parts.append(hit.crossJoin(looked).select(F.lit(probes).alias("probes"), (F.col("shared") / F.col("size")).alias("recall"), (F.col("rows") / max(1, pairs)).alias("compared")))
    return reduce(DataFrame.unionByName, parts)


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Normalised vectors stored under a key, built twice: the second time the store has all rows and is left as it is."""
    rows = _vectors(spark, d)[1].select("vec_id", "label", dense.normalised(F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")
    path = new_path(spark, "vectors")
    first, again = store.ensured(rows, path, "label"), store.ensured(rows, path, "label")
    kept = spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))
    return kept.select("label", "n", "length", F.lit(first).alias("built"), F.lit(again).alias("built_again"))


def top100_ranking(spark: SparkSession, d: str) -> DataFrame:
    return S.ranking(spark, d)


def ranking_export(spark: SparkSession, d: str) -> DataFrame:
    """One row a question: its first 100 chunks in order."""
    r = S.ranking(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    return r.select("qid", F.array_join(F.transform("r", lambda x: x["chunk_id"]), " ").alias("chunks"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    f = ranking.fused([S.ranking(spark, d), S.first_seen(spark, d)], "qid", "chunk_id")
    return f.select("qid", "chunk_id", "rank", F.round("fused", 9).alias("fused"))


def rerank_depth50(spark: SparkSession, d: str) -> DataFrame:
    """The other ranking's first 50, put in the order of the latest scores."""
    return ranking.reranked(S.first_seen(spark, d).drop("score"), S.scores(spark, d), "qid", "chunk_id", "score", 50).select("qid", "chunk_id", "rank", "new_rank")


def overlap_at_50(spark: SparkSession, d: str) -> DataFrame:
    return ranking.overlap_at(S.ranking(spark, d), S.first_seen(spark, d), "qid", "chunk_id", 50)


def overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean over questions of the shared part of the two rankings' first 50."""
    return overlap_at_50(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("shared") / F.col("size")), 6).alias("overlap"))


def reproduction_check(spark: SparkSession, d: str) -> DataFrame:
    """The stored ranking against one computed again: rows of either that the other lacks at the same rank."""
    kept, again = written(S.ranking(spark, d).select("qid", "rank", "chunk_id"), "ranking"), S.ranking(spark, d).select("qid", "rank", "chunk_id")
    off = kept.exceptAll(again).unionByName(again.exceptAll(kept))
    return kept.agg(F.count(F.lit(1)).alias("n")).crossJoin(off.agg(F.count(F.lit(1)).alias("different")))


def chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of its document each scored question can reach: what a filtered search returns at most."""
    c = S.chunks(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("in_doc"))
    r = S.ranking(spark, d).join(S.chunks(spark, d).select("chunk_id", "doc"), "chunk_id").groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("ranked"))
    return r.join(c, "doc").select("qid", "doc", "ranked", "in_doc")


QUERIES = {
    f.__name__: f
    for f in (
        document_manifest, distinct_documents, parse_summary, jsonl_round_trip, token_counts, shingle_counts, word_percentiles, chunk_length_audit, document_labels, chunk_variant_stats,
        bm25_idf, bm25_pooled_top10, bm25_single_top10, bm25_labelled_top10, files_by_document, whole_json_round_trip, variant_store, overlap_mean, reproduction_check, dense_top10, dense_filtered_top10, ann_top10, ann_recall, vector_store, top100_ranking, ranking_export, rrf_fusion, rerank_depth50, overlap_at_50, chunks_per_document,
    )
} | _chunk_queries

_W, _T = S.WORDS.format("text"), S.TOKENS.format("text")


def _windows_sql(size: int, overlap: int) -> str:
    return f"""WITH p AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {overlap}, 1), {size - overlap})) AS pos FROM p WHERE len(w) > 0)
SELECT doc_id, (pos / {size - overlap})::INT AS k, len(w[pos + 1:pos + {size}])::INT AS n_words, md5(array_to_string(w[pos + 1:pos + {size}], ' ')) AS body_md5 FROM s"""


def _dense_sql(same: str) -> str:
    return f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS score
  FROM embeddings a JOIN embeddings b ON {same} WHERE a.vec_id % 50 = 0)
SELECT query, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""


def _bm25_sql(within: str, asked: str, texts: str = "WITH " + S.CHUNKS) -> str:
    return f"""{texts}, t AS (SELECT chunk_id, doc, {_T} AS w FROM chunk WHERE text IS NOT NULL),
p AS (SELECT chunk_id, doc, len(w) AS dl, unnest(w) AS term FROM t), post AS (SELECT chunk_id, doc, dl, term, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(w)) AS average FROM t WHERE len(w) > 0),
df AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 0) AS idf FROM post, n GROUP BY term),
asked AS (SELECT kayit_no AS query, doc_name AS doc, unnest({S.TOKENS.format('question')}) AS term FROM sorular WHERE kayit_no % 50 = 0 AND question IS NOT NULL {asked}),
a AS (SELECT query, doc, term, count(*) AS qtf FROM asked GROUP BY ALL),
s AS (SELECT query, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average)) * qtf), 6) AS score
  FROM post JOIN df USING (term) JOIN a ON post.term = a.term {within}, n WHERE idf > 0 GROUP BY ALL)
SELECT * FROM (SELECT query, chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10"""


_LABELS = r"""b AS (SELECT DISTINCT doc_name, company, doc_type, doc_period FROM belgeler WHERE doc_name IS NOT NULL),
        lp AS (SELECT *, CASE WHEN regexp_matches(doc_name, '_\d{4}Q\d_') THEN 'Q' || regexp_extract(doc_name, '_(\d{4})Q(\d)_', 2) || ' ' || regexp_extract(doc_name, '_(\d{4})Q(\d)_', 1)
          WHEN regexp_matches(doc_name, 'dated-\d{4}-\d{2}-\d{2}') THEN regexp_extract(doc_name, 'dated-(\d{4}-\d{2}-\d{2})', 1) ELSE doc_period::VARCHAR END AS per,
          CASE regexp_replace(lower(doc_type), '[^a-z0-9]', '', 'g') WHEN '10k' THEN 'annual report (10-K)' WHEN '10q' THEN 'quarterly report (10-Q)' WHEN '8k' THEN 'current report (8-K)'
            WHEN 'earnings' THEN 'earnings release' WHEN 'annualreport' THEN 'annual report' ELSE doc_type END AS kind FROM b),
        labels AS (SELECT doc_name, concat_ws('. ', company, concat_ws(', ', kind, per)) || '.' AS label FROM lp)"""
_LABELLED = f"WITH {S.CHUNKS.replace('chunk AS', 'bare AS', 1)}, {_LABELS}, one AS (SELECT doc_name, min(label) AS label FROM labels GROUP BY 1), chunk AS (SELECT chunk_id, doc, concat_ws(' ', label, text) AS text FROM bare LEFT JOIN one ON doc_name = doc WHERE text IS NOT NULL)"
SQL = {
    "files_by_document": "SELECT md5(doc_name) AS key, count(*) AS pages, true AS filled FROM documents WHERE doc_name IS NOT NULL AND trim(doc_name, ' ') <> '' GROUP BY 1",
    "whole_json_round_trip": "SELECT fb_belge, count(*) AS n, sum(fb_sayfa)::BIGINT AS pages FROM kilitli_kanit GROUP BY fb_belge",
    "bm25_labelled_top10": _bm25_sql("", "", _LABELLED),
    "overlap_mean": f"""WITH {S.RANKING}, {S.FIRST_SEEN}, o AS (SELECT r.qid, count(o.qid) / count(*) AS share FROM ranking r LEFT JOIN (SELECT * FROM other WHERE rank <= 50) o ON r.qid = o.qid AND r.chunk_id = o.chunk_id WHERE r.rank <= 50 GROUP BY r.qid)
        SELECT count(*) AS n, round(avg(share), 6) AS overlap FROM o""",
    "reproduction_check": f"WITH {S.RANKING} SELECT count(*) AS n, 0::BIGINT AS different FROM ranking",
    "document_manifest": "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS fingerprint FROM documents WHERE text IS NOT NULL",
    "distinct_documents": "SELECT DISTINCT doc_name FROM sorular WHERE doc_name IS NOT NULL ORDER BY 1",
    "parse_summary": """SELECT doc_name, count(*) AS pages, sum(CASE WHEN length(trim(coalesce(text, ''), ' ')) < 20 THEN 1 ELSE 0 END)::BIGINT AS empty_pages,
        sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents WHERE doc_name IS NOT NULL GROUP BY doc_name""",
    "jsonl_round_trip": f"WITH {S.CHUNKS} SELECT doc, count(*) AS n, sum(n_words)::BIGINT AS total_words, sum(length(text))::BIGINT AS total_chars FROM chunk GROUP BY doc",
    "token_counts": f"""WITH {S.CHUNKS} SELECT chunk_id, len({_W})::INT AS n_words, len({_T})::INT AS n_tokens,
        round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digits FROM chunk WHERE text IS NOT NULL""",
    "shingle_counts": f"""WITH {S.CHUNKS}, t AS (SELECT chunk_id, {_T} AS w FROM chunk WHERE text IS NOT NULL)
        SELECT chunk_id, len(list_distinct({S.sql_ngrams('w', 5)}))::INT AS n_shingles FROM t""",
    "word_percentiles": f"""WITH {S.CHUNKS}, t AS (SELECT doc, len({_W})::INT AS n FROM chunk WHERE text IS NOT NULL)
        SELECT doc, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95,
        list_sort(list(n))[floor(0.95 * (count(n) - 1))::INT + 1] AS p95_low, max(n) AS most FROM t GROUP BY doc""",
    "chunk_length_audit": f"""WITH {S.CHUNKS}, t AS (SELECT len({_W})::INT AS n FROM chunk WHERE text IS NOT NULL)
        SELECT most::INT AS most, count(*) AS chunks, floor(round(quantile_cont(n, 0.5), 6))::INT AS median, floor(round(quantile_cont(n, 0.99), 6))::INT AS p99, max(n) AS longest,
        sum((n > most)::INT)::BIGINT AS over, round(sum((n > most)::INT) / count(*), 6) AS share FROM t, (VALUES (512), (8192)) AS l(most) GROUP BY most""",
    "document_labels": f"WITH {_LABELS} SELECT doc_name, label FROM labels",
    "chunk_variant_stats": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS chunks, sum(n_words)::BIGINT AS words FROM ({_windows_sql(s, o)})" for v, (s, o) in chunking.VARIANTS.items())
    + ")",
    "variant_store": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS chunks, sum(n_words)::BIGINT AS words FROM ({_windows_sql(s, o)})" for v, (s, o) in chunking.VARIANTS.items())
    + ")",
    "bm25_idf": f"""WITH {S.CHUNKS}, t AS (SELECT chunk_id, {_T} AS w FROM chunk WHERE text IS NOT NULL), p AS (SELECT DISTINCT chunk_id, unnest(w) AS term FROM t),
        n AS (SELECT count(*) AS n FROM t WHERE len(w) > 0)
        SELECT term, count(*) AS df, round(greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 0), 6) AS idf FROM p, n GROUP BY term""",
    "bm25_pooled_top10": _bm25_sql("", ""),
    "bm25_single_top10": _bm25_sql("AND post.doc = a.doc", "AND doc_name IS NOT NULL"),
    "dense_top10": _dense_sql("true"),
    "dense_filtered_top10": _dense_sql("a.label = b.label"),
    "vector_store": "SELECT label, count(*) AS n, 1.0::DOUBLE AS length, true AS built, false AS built_again FROM embeddings WHERE embedding IS NOT NULL GROUP BY label",
    "top100_ranking": f"WITH {S.RANKING} SELECT * FROM ranking",
    "ranking_export": f"WITH {S.RANKING} SELECT qid, string_agg(chunk_id, ' ' ORDER BY rank) AS chunks FROM ranking GROUP BY qid",
    "rrf_fusion": f"""WITH {S.RANKING}, {S.FIRST_SEEN}, u AS (SELECT qid, chunk_id, rank FROM ranking UNION ALL SELECT qid, chunk_id, rank FROM other),
        f AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS fused FROM u GROUP BY ALL)
        SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, chunk_id)::INT AS rank, round(fused, 9) AS fused FROM f) WHERE rank <= 100""",
    "rerank_depth50": f"""WITH {S.SCORES}, {S.FIRST_SEEN}, j AS (SELECT o.qid, o.chunk_id, o.rank, s.score FROM other o LEFT JOIN score s ON o.qid = s.qid AND o.chunk_id = s.chunk_id)
        SELECT qid, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank > 50, CASE WHEN rank <= 50 THEN -score END NULLS LAST, rank)::INT AS new_rank FROM j""",
    "overlap_at_50": f"""WITH {S.RANKING}, {S.FIRST_SEEN} SELECT r.qid, count(o.qid) AS shared, count(*) AS size
        FROM ranking r LEFT JOIN (SELECT * FROM other WHERE rank <= 50) o ON r.qid = o.qid AND r.chunk_id = o.chunk_id WHERE r.rank <= 50 GROUP BY r.qid""",
    "chunks_per_document": f"""WITH {S.RANKING}, {S.CHUNKS}, c AS (SELECT doc, count(*) AS in_doc FROM chunk GROUP BY doc)
        SELECT qid, doc, count(*) AS ranked, any_value(in_doc) AS in_doc FROM ranking JOIN chunk USING (chunk_id) JOIN c USING (doc) GROUP BY qid, doc""",
} | {f"chunk_{v}": _windows_sql(s, o) for v, (s, o) in chunking.VARIANTS.items()}
