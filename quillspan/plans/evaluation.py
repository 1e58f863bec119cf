"""Queries that measure rankings against evidence, build contexts and resample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import metrics, requests
from quillspan.plans import shared as S
from quillspan.session import written


def _located(spark: SparkSession, d: str) -> DataFrame:
    return S.ranking(spark, d).join(S.chunks(spark, d), "chunk_id")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_hits(S.evidence(spark, d), _located(spark, d).select("qid", "rank", "doc", "page"))


def first_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("hit").isNull(), "none").when(F.col("hit") <= 5, "1-5").when(F.col("hit") <= 10, "6-10").when(F.col("hit") <= 50, "11-50").otherwise("51-100")
    return _hits(spark, d).withColumn("bucket", bucket)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall(_hits(spark, d))


def _locked(spark: SparkSession, d: str) -> DataFrame:
    """(qid) of the questions on companies of the held-out third."""
    return S.questions(spark, d).where(S.locked(S.company(F.col("doc"), F.col("qid")))).select("qid")


def development_scan(spark: SparkSession, d: str) -> DataFrame:
    """Questions outside the held-out third, with the pages of their evidence in its order."""
    q = S.questions(spark, d).join(_locked(spark, d), "qid", "left_anti")
    pages = F.transform("evidence", lambda e: F.concat_ws(":", e["doc_name"], e["evidence_page_num"].cast("string")))
    return q.select("qid", F.coalesce(F.array_join(pages, " "), F.lit("")).alias("pages"))


def development_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over development questions alone; it stops if a held-out one is among them."""
    dev = requests.refuse_locked(development_scan(spark, d), _locked(spark, d))
    return metrics.recall(_hits(spark, d).join(dev.select("qid"), "qid", "left_semi"))


def all_evidence_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Questions all of whose evidence is found by rank 5, 10 and 50."""
    worst = _hits(spark, d).groupBy("qid").agg(F.max(F.coalesce("hit", F.lit(10**6))).alias("worst"))
    return worst.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("worst") <= k).cast("int")).cast("bigint").alias(f"all_at_{k}") for k in (5, 10, 50)])


def document_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of the scored questions with evidence: those with a chunk of an evidence document among the first 5 and 50."""
    asked = S.evidence(spark, d).where("doc IS NOT NULL").select("qid", "doc").distinct()
    best = asked.join(_located(spark, d).groupBy("qid", "doc").agg(F.min("rank").alias("rank")), ["qid", "doc"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return best.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hit_at_{k}") for k in (5, 50)])


def rank_buckets_by_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = S.questions(spark, d).select("qid", "question_type")
    return first_hit_rank(spark, d).join(kinds, "qid").groupBy("question_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _budgeted(spark: SparkSession, d: str) -> DataFrame:
    """The ranking with the words of each chunk; chunks without text have none."""
    return _located(spark, d).withColumn("n_words", F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)))


def budget_window(spark: SparkSession, d: str) -> DataFrame:
    return metrics.within_budget(_budgeted(spark, d)).select("qid", "chunk_id", "rank", "n_words", "before")


def budget_recall(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows whose page is in the window of 1000 words."""
    pages = context_pages(spark, d).withColumn("hit", F.lit(1))
    found = S.evidence(spark, d).join(pages, ["qid", "doc", "page"], "left")
    return found.agg(F.count("hit").alias("num"), F.count(F.lit(1)).alias("den"))


def context_cut(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cut_to_budget(_budgeted(spark, d)).select("qid", "chunk_id", "rank", "taken")


def context_render(spark: SparkSession, d: str) -> DataFrame:
    """The context of each question: tagged blocks of at most 1000 words in all, joined by blank lines."""
    block = F.concat(F.lit("[doc: "), "doc", F.lit(", page: "), "page", F.lit("]\n"), F.array_join(F.slice(T.words(F.col("text")), 1, F.col("taken").cast("int")), " "))
    cut = metrics.cut_to_budget(_budgeted(spark, d)).where("taken > 0").select("qid", F.struct("rank", block.alias("block")).alias("b"))
    context = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    return cut.groupBy("qid").agg(context.alias("context")).select("qid", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """(qid, kosul, context, n_words, pages): the first 1000 words of the ranking (K1), and the texts of all evidence pages (K2)."""
    blocks = lambda: F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    tag = F.concat(F.lit("[doc: "), "doc", F.lit(", page: "), F.col("page").cast("string"), F.lit("]\n"))
    cut = metrics.cut_to_budget(_budgeted(spark, d)).where("taken > 0")
    cut = cut.withColumn("b", F.struct("rank", F.concat(tag, F.array_join(F.slice(T.words(F.col("text")), 1, F.col("taken").cast("int")), " ")).alias("block"), "doc", "page"))
    page = lambda b: F.struct(b["doc"].alias("doc"), b["page"].cast("int").alias("page"))
    first = cut.groupBy("qid").agg(blocks().alias("context"), F.sum("taken").alias("n_words"), F.transform(F.array_sort(F.collect_list("b")), page).alias("pages"))
    e = S.questions(spark, d).select("qid", F.explode("evidence").alias("e")).where("e.doc_name IS NOT NULL AND e.evidence_page_num IS NOT NULL")
    whole = e.groupBy("qid", F.col("e.doc_name").alias("doc"), F.col("e.evidence_page_num").alias("page")).agg(F.max(F.coalesce("e.evidence_text_full_page", "e.evidence_text")).alias("text"))
    whole = whole.withColumn("w", F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))).withColumn("b", F.struct("doc", "page", F.concat(tag, F.array_join("w", " ")).alias("block")))
    oracle = whole.groupBy("qid").agg(blocks().alias("context"), F.sum(F.size("w")).alias("n_words"), F.transform(F.array_sort(F.collect_list("b")), page).alias("pages"))
    return first.withColumn("kosul", F.lit("K1")).unionByName(oracle.withColumn("kosul", F.lit("K2")))


def reader_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all conditions: their words, pages and fingerprint."""
    r = requests.requests(S.questions(spark, d), _contexts(spark, d))
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["doc"], p["page"].cast("string"))), " ")
    return r.select("qid", "kosul", "version", "n_words", pages.alias("pages"), F.md5("text").alias("text_md5"))


def context_statistics(spark: SparkSession, d: str) -> DataFrame:
    """By condition: requests, mean words, share with any evidence page, mean share of the evidence pages."""
    r = _contexts(spark, d).select("qid", "kosul", "n_words", "pages")
    gold = S.evidence(spark, d).where("doc IS NOT NULL AND page IS NOT NULL").groupBy("qid").agg(F.collect_set(F.struct("doc", F.col("page").cast("int").alias("page"))).alias("gold"))
    j = r.join(gold, "qid").withColumn("share", F.size(F.array_intersect("gold", F.array_distinct("pages"))) / F.size("gold"))
    return j.groupBy("kosul").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"), F.round(F.avg((F.col("share") > 0).cast("int")), 6).alias("any_page"), F.round(F.avg("share"), 6).alias("page_share"))


def oracle_context(spark: SparkSession, d: str) -> DataFrame:
    """Distinct evidence pages of each question in order."""
    e = S.evidence(spark, d).where("doc IS NOT NULL AND page IS NOT NULL").select("qid", "doc", "page").distinct()
    pages = F.transform(F.array_sort(F.collect_list(F.struct("doc", "page"))), lambda p: F.concat_ws(":", p["doc"], p["page"].cast("string")))
    return e.groupBy("qid").agg(F.array_join(pages, " ").alias("pages"), F.count(F.lit(1)).alias("n"))


def context_pages(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc, page) of the chunks in each question's window of 1000 words."""
    return metrics.within_budget(_budgeted(spark, d)).select("qid", "doc", "page").distinct()


def context_hit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the window holds any evidence page of the question."""
    pages = context_pages(spark, d).withColumn("seen", F.lit(1))
    e = S.evidence(spark, d).join(pages, ["qid", "doc", "page"], "left")
    return e.groupBy("qid").agg((F.count("seen") > 0).alias("hit"))


def text_coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.text_coverage(S.evidence(spark, d), _located(spark, d))


def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """(qid, ev, covered, size): 5-grams of an evidence text that any chunk of the window holds."""
    e = S.evidence(spark, d).select("qid", "ev", F.array_distinct(T.ngrams(T.tokens(F.col("text")), 5)).alias("g")).where(F.size("g") > 0)
    window = metrics.within_budget(_budgeted(spark, d)).select("qid", F.explode(T.ngrams(T.tokens(F.col("text")), 5)).alias("gram")).distinct().withColumn("seen", F.lit(1))
    return e.select("qid", "ev", F.explode("g").alias("gram")).join(window, ["qid", "gram"], "left").groupBy("qid", "ev").agg(F.count("seen").alias("covered"), F.count(F.lit(1)).alias("size"))


def window_pages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages in the windows of 1000 words: their mean over questions."""
    n = context_pages(spark, d).groupBy("qid").agg(F.count(F.lit(1)).alias("pages"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pages"), 6).alias("mean_pages"))


def question_record(spark: SparkSession, d: str) -> DataFrame:
    """One row a question: its evidence rows, those found by rank 5, 10 and 50 and in the window, the sum of reciprocal ranks in
    millionths, and the share of its evidence pages that the window holds."""
    seen = context_pages(spark, d).withColumn("seen", F.lit(1))
    e = S.evidence(spark, d).join(_hits(spark, d), ["qid", "ev"]).join(seen, ["qid", "doc", "page"], "left")
    page = F.when(F.col("doc").isNotNull() & F.col("page").isNotNull(), F.struct("doc", "page"))
    found = [F.count(F.when(F.col("hit") <= k, 1)).alias(f"hit_at_{k}") for k in (5, 10, 50)]
    pages = F.round(F.countDistinct(F.when(F.col("seen") == 1, page)) / F.countDistinct(page), 6).alias("page_share")
    return e.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), *found, F.sum(F.coalesce(F.round(1e6 / F.col("hit")), F.lit(0.0)).cast("bigint")).alias("rr"), F.count("seen").alias("in_window"), pages)


def macro_recall(spark: SparkSession, d: str) -> DataFrame:
    """Means over questions of what each question found, whatever number of evidence rows it has."""
    r = question_record(spark, d)
    share = lambda c: F.round(F.avg(F.col(c) / F.col("n")), 6).alias(c)
    return r.agg(F.count(F.lit(1)).alias("questions"), share("hit_at_5"), share("hit_at_10"), share("in_window"), F.round(F.avg("page_share"), 6).alias("page_share"))


def error_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Evidence found by rank 5 and all, by kind of question and by the question's number of evidence rows (3 for more), with the
    median share of digits in the texts found and missed."""
    sizes = S.evidence(spark, d).groupBy("qid").agg(F.least(F.count(F.lit(1)), F.lit(3)).cast("string").alias("rows"))
    e = S.evidence(spark, d).join(_hits(spark, d), ["qid", "ev"]).join(S.questions(spark, d).select("qid", F.coalesce("question_type", F.lit("-")).alias("kind")), "qid").join(sizes, "qid")
    e = e.select((F.col("hit") <= 5).alias("found"), F.round(T.digit_share(F.coalesce("text", F.lit(""))), 3).alias("digits"), F.explode(F.array(F.struct(F.lit("kind").alias("by"), F.col("kind").alias("value")), F.struct(F.lit("rows").alias("by"), F.col("rows").alias("value")))).alias("s"))
    # Shares are in thousandths, so that a median counts at most a thousand values of a group.
    e = e.groupBy("s.by", "s.value", F.coalesce("found", F.lit(False)).alias("found"), "digits").agg(F.count(F.lit(1)).alias("times"))
    median = lambda found: F.round(F.percentile(F.when(F.col("found") == found, F.col("digits")), F.lit(0.5), F.col("times")), 6)
    return e.groupBy("by", "value").agg(F.sum(F.when(F.col("found"), F.col("times")).otherwise(0)).alias("found"), F.sum("times").alias("n"), median(True).alias("digits_found"), median(False).alias("digits_missed"))


def _units(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Evidence found by rank 10 and all evidence, by company (or question)."""
    return _hits(spark, d).join(_companies(spark, d), "qid").groupBy(F.col(column).alias("unit")).agg(F.sum(F.when(F.col("hit") <= 10, 1).otherwise(0)).alias("num"), F.count(F.lit(1)).alias("den"))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).select("qid", S.company(F.col("doc"), F.col("qid")).alias("company"))


#: Repetitions of a measure's interval and of a comparison's.
REPS, PAIRED_REPS = 2_000, 10_000


def _ci(spark: SparkSession, d: str, column: str) -> DataFrame:
    reps = metrics.bootstrap(_units(spark, d, column), ["num", "den"], REPS).withColumn("value", F.round(F.col("num") / F.col("den"), 9))
    return metrics.interval(reps, "value", REPS)


def question_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _ci(spark, d, "qid")


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _ci(spark, d, "company")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """(qid, company, num_a, num_b, den): evidence of each question that the two rankings find by rank 10."""
    other = S.first_seen(spark, d).join(S.chunks(spark, d).select("chunk_id", "doc", "page"), "chunk_id")
    b = metrics.first_hits(S.evidence(spark, d), other.select("qid", "rank", "doc", "page")).withColumnRenamed("hit", "hit_b")
    one = lambda c: F.sum(F.when(F.col(c) <= 10, 1).otherwise(0))
    return _hits(spark, d).join(b, ["qid", "ev"]).join(_companies(spark, d), "qid").groupBy("qid", "company").agg(one("hit").alias("num_a"), one("hit_b").alias("num_b"), F.count(F.lit(1)).alias("den"))


def _delta(units: DataFrame) -> DataFrame:
    """The difference of two ratios of sums over all units, its interval over drawn ones, and whether that leaves out 0."""
    units = written(units, "units")
    reps = metrics.bootstrap(units, ["num_a", "num_b", "den"], PAIRED_REPS).withColumn("value", F.round((F.col("num_a") - F.col("num_b")) / F.col("den"), 9))
    delta = units.agg(F.round((F.sum("num_a") - F.sum("num_b")) / F.sum("den"), 9).cast("double").alias("delta"))
    low, high = F.col("ci_lo"), F.col("ci_hi")
    return delta.crossJoin(metrics.interval(reps, "value", PAIRED_REPS)).select("delta", low, high, ((low > 0) | (high < 0)).alias("significant"))


def _by(rows: DataFrame, unit: str) -> DataFrame:
    return rows.groupBy(F.col(unit).alias("unit")).agg(*[F.sum(c).alias(c) for c in ("num_a", "num_b", "den")])


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the two rankings on the same drawn companies."""
    return _delta(_by(_paired(spark, d), "company"))


def paired_delta_questions(spark: SparkSession, d: str) -> DataFrame:
    """The same on drawn questions."""
    return _delta(_by(_paired(spark, d), "qid"))


def paired_delta_values(spark: SparkSession, d: str) -> DataFrame:
    """The difference of the means of what each question finds, on drawn companies with all of their questions; shares of a question
    are counted in millionths."""
    share = lambda c: F.round(1e6 * F.col(c) / F.col("den")).cast("bigint").alias(c)
    return _delta(_by(_paired(spark, d).select("company", share("num_a"), share("num_b"), F.lit(1_000_000).cast("bigint").alias("den")), "company"))


QUERIES = {
    f.__name__: f
    for f in (
        first_hit_rank, recall_at_k, development_scan, development_recall, all_evidence_at_k, document_hit_at_k, rank_buckets_by_type, budget_window, budget_recall, context_cut, context_render, oracle_context,
        context_hit, text_coverage_at_k, union_coverage, window_pages, question_record, macro_recall, error_analysis, question_bootstrap, cluster_bootstrap, paired_delta,
        paired_delta_questions, paired_delta_values, reader_requests, context_statistics,
    )
}

_HITS = f"""WITH {S.RANKING}, {S.CHUNKS}, {S.EVIDENCE}, located AS (SELECT * FROM ranking JOIN chunk USING (chunk_id)),
  hits AS (SELECT ev.qid, ev.ev, min(l.rank) AS hit FROM ev LEFT JOIN located l ON l.qid = ev.qid AND l.doc = ev.doc AND l.page = ev.page GROUP BY ALL)"""
_BUCKET = "CASE WHEN hit IS NULL THEN 'none' WHEN hit <= 5 THEN '1-5' WHEN hit <= 10 THEN '6-10' WHEN hit <= 50 THEN '11-50' ELSE '51-100' END"
_W, _T = S.WORDS.format("text"), S.TOKENS.format("text")
BUDGET_SQL = (
    _HITS
    + f""", counted AS (SELECT * EXCLUDE (n_words), coalesce(len({_W}), 0)::INT AS n_words FROM located),
  win AS (SELECT * FROM (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM counted) WHERE before < 1000),
  seen AS (SELECT DISTINCT qid, doc, page FROM win)"""
)


def _bootstrap_sql(units: str, value: str, sums: str, reps: int) -> str:
    return f""", units AS ({units}), numbered AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS number FROM units), n AS (SELECT count(*) AS n FROM units),
  picked AS (SELECT rep, ('0x' || substr(md5('1|' || rep || '|' || slot), 1, 8))::BIGINT % n AS number FROM n, unnest(range(0, {reps})) AS r(rep), unnest(range(0, n)) AS s(slot)),
  reps AS (SELECT rep, {sums} FROM picked JOIN numbered USING (number) GROUP BY rep), v AS (SELECT list_sort(list(round({value}, 9))) AS v FROM reps)"""


def _ci_sql(unit: str) -> str:
    units = f"SELECT {unit} AS unit, sum(CASE WHEN hit <= 10 THEN 1 ELSE 0 END) AS num, count(*) AS den FROM hits JOIN q USING (qid) GROUP BY 1"
    return _HITS + _bootstrap_sql(units, "num / den", "sum(num) AS num, sum(den) AS den", 2000) + " SELECT v[51] AS ci_lo, v[1951] AS ci_hi FROM v"


_COMPANY = "upper(split_part(coalesce(q.doc, qid), '_', 1))"


def _delta_sql(unit: str, share: bool = False) -> str:
    one = lambda c: f"round(1e6 * {c} / den)::BIGINT" if share else c
    return (
        _HITS
        + f""", {S.FIRST_SEEN}, located_b AS (SELECT * FROM other JOIN chunk USING (chunk_id)), hits_b AS (SELECT ev.qid, ev.ev, min(l.rank) AS hit_b FROM ev LEFT JOIN located_b l ON l.qid = ev.qid AND l.doc = ev.doc AND l.page = ev.page GROUP BY ALL),
  per AS (SELECT qid, {_COMPANY} AS company, sum(CASE WHEN hit <= 10 THEN 1 ELSE 0 END) AS num_a, sum(CASE WHEN hit_b <= 10 THEN 1 ELSE 0 END) AS num_b, count(*) AS den FROM hits JOIN hits_b USING (qid, ev) JOIN q USING (qid) GROUP BY ALL)"""
        + _bootstrap_sql(f"SELECT {unit} AS unit, sum({one('num_a')}) AS num_a, sum({one('num_b')}) AS num_b, sum({'1000000' if share else 'den'}) AS den FROM per GROUP BY 1", "(num_a - num_b) / den", "sum(num_a) AS num_a, sum(num_b) AS num_b, sum(den) AS den", 10_000)
        + " SELECT (SELECT round((sum(num_a) - sum(num_b)) / sum(den), 9) FROM units) AS delta, v[251] AS ci_lo, v[9751] AS ci_hi, v[251] > 0 OR v[9751] < 0 AS significant FROM v"
    )


_RECORD = (
    BUDGET_SQL
    + """, rec AS (SELECT ev.qid, count(*) AS n, count(*) FILTER (WHERE hit <= 5) AS hit_at_5, count(*) FILTER (WHERE hit <= 10) AS hit_at_10, count(*) FILTER (WHERE hit <= 50) AS hit_at_50,
  sum(coalesce(round(1e6 / hit), 0)::BIGINT)::BIGINT AS rr, count(s.qid) AS in_window,
  round(count(DISTINCT CASE WHEN s.qid IS NOT NULL THEN {'d': ev.doc, 'p': ev.page} END) / nullif(count(DISTINCT CASE WHEN ev.doc IS NOT NULL AND ev.page IS NOT NULL THEN {'d': ev.doc, 'p': ev.page} END), 0), 6) AS page_share
  FROM ev JOIN hits USING (qid, ev) LEFT JOIN seen s ON s.qid = ev.qid AND s.doc = ev.doc AND s.page = ev.page GROUP BY ev.qid)"""
)
_CONTEXTS = (
    BUDGET_SQL
    + f""", k1c AS (SELECT *, least(n_words, 1000 - before) AS taken FROM win),
  k1 AS (SELECT qid, 'K1' AS kosul, string_agg('[doc: ' || doc || ', page: ' || page || ']' || chr(10) || array_to_string(({_W})[1:taken], ' '), chr(10) || chr(10) ORDER BY rank) AS context, sum(taken)::BIGINT AS n_words,
    list({{'doc': doc, 'page': page}} ORDER BY rank) AS pages FROM k1c WHERE taken > 0 GROUP BY qid),
  k2p AS (SELECT qid, e.doc_name AS doc, e.evidence_page_num AS page, max(coalesce(e.evidence_text_full_page, e.evidence_text)) AS text FROM (SELECT qid, unnest(evidence) AS e FROM q)
    WHERE e.doc_name IS NOT NULL AND e.evidence_page_num IS NOT NULL GROUP BY ALL),
  k2w AS (SELECT qid, doc, page, coalesce({_W}, []) AS w FROM k2p),
  k2 AS (SELECT qid, 'K2' AS kosul, string_agg('[doc: ' || doc || ', page: ' || page || ']' || chr(10) || array_to_string(w, ' '), chr(10) || chr(10) ORDER BY doc, page) AS context, sum(len(w))::BIGINT AS n_words,
    list({{'doc': doc, 'page': page}} ORDER BY doc, page) AS pages FROM k2w GROUP BY qid), ctx AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2)"""
)

def _recall_sql(hits: str) -> str:
    parts = [f"SELECT 'recall@{k}' AS metric, sum(CASE WHEN hit <= {k} THEN 1 ELSE 0 END)::BIGINT AS num, count(*) AS den FROM {hits}" for k in (1, 5, 10, 20, 50)]
    return f" SELECT * FROM ({' UNION ALL '.join(parts)} UNION ALL SELECT 'mrr', sum(coalesce(round(1e6 / hit), 0)::BIGINT)::BIGINT, count(*) FROM {hits})"


SQL = {
    "first_hit_rank": _HITS + f" SELECT qid, ev, hit, {_BUCKET} AS bucket FROM hits",
    "recall_at_k": _HITS + _recall_sql("hits"),
    "development_scan": f"""WITH {S.QUESTIONS} SELECT qid, coalesce(array_to_string(list_transform(evidence, lambda e: concat_ws(':', e.doc_name, e.evidence_page_num::VARCHAR)), ' '), '') AS pages FROM q WHERE NOT {S.LOCKED.format('qid')}""",
    "development_recall": _HITS + f", dh AS (SELECT hits.* FROM hits SEMI JOIN (SELECT qid FROM q WHERE NOT {S.LOCKED.format('qid')}) USING (qid)) " + _recall_sql("dh"),
    "all_evidence_at_k": _HITS
    + ", w AS (SELECT qid, max(coalesce(hit, 1000000)) AS worst FROM hits GROUP BY qid) SELECT count(*) AS n, count(*) FILTER (WHERE worst <= 5) AS all_at_5, count(*) FILTER (WHERE worst <= 10) AS all_at_10, count(*) FILTER (WHERE worst <= 50) AS all_at_50 FROM w",
    "document_hit_at_k": _HITS
    + """, b AS (SELECT ev.qid, min(rank) AS rank FROM ev LEFT JOIN located l ON l.qid = ev.qid AND l.doc = ev.doc WHERE ev.doc IS NOT NULL GROUP BY ev.qid)
  SELECT count(*) AS n, count(*) FILTER (WHERE rank <= 5) AS hit_at_5, count(*) FILTER (WHERE rank <= 50) AS hit_at_50 FROM b""",
    "rank_buckets_by_type": _HITS + f" SELECT question_type, {_BUCKET} AS bucket, count(*) AS n FROM hits JOIN q USING (qid) GROUP BY ALL",
    "budget_window": BUDGET_SQL + " SELECT qid, chunk_id, rank, n_words, before FROM win",
    "budget_recall": BUDGET_SQL + " SELECT count(s.qid) AS num, count(*) AS den FROM ev LEFT JOIN seen s ON s.qid = ev.qid AND s.doc = ev.doc AND s.page = ev.page",
    "context_cut": BUDGET_SQL + " SELECT qid, chunk_id, rank, least(n_words::BIGINT, 1000 - before) AS taken FROM win",
    "context_render": BUDGET_SQL
    + f""", cut AS (SELECT *, least(n_words, 1000 - before) AS taken FROM win),
  c AS (SELECT qid, string_agg('[doc: ' || doc || ', page: ' || page || ']' || chr(10) || array_to_string(({_W})[1:taken], ' '), chr(10) || chr(10) ORDER BY rank) AS context FROM cut WHERE taken > 0 GROUP BY qid)
  SELECT qid, length(context)::INT AS chars, md5(context) AS context_md5 FROM c""",
    "oracle_context": f"WITH {S.EVIDENCE}, p AS (SELECT DISTINCT qid, doc, page FROM ev WHERE doc IS NOT NULL AND page IS NOT NULL) SELECT qid, string_agg(doc || ':' || page, ' ' ORDER BY doc, page) AS pages, count(*) AS n FROM p GROUP BY qid",
    "context_hit": BUDGET_SQL + " SELECT ev.qid, count(s.qid) > 0 AS hit FROM ev LEFT JOIN seen s ON s.qid = ev.qid AND s.doc = ev.doc AND s.page = ev.page GROUP BY ev.qid",
    "text_coverage_at_k": _HITS
    + f""", wt AS (SELECT qid, ev, {S.TOKENS.format('text')} AS w FROM ev), wg AS (SELECT qid, ev, list_distinct({S.sql_ngrams('w', 5)}) AS g FROM wt WHERE len(w) >= 5),
  lt AS (SELECT qid, rank, {_T} AS w FROM located WHERE rank <= 10), lg AS (SELECT qid, rank, unnest(list_distinct({S.sql_ngrams('w', 5)})) AS gram FROM lt),
  wl AS (SELECT qid, ev, unnest(g) AS gram FROM wg), sh AS (SELECT wl.qid, ev, rank, count(*) AS shared FROM wl JOIN lg ON wl.qid = lg.qid AND wl.gram = lg.gram GROUP BY ALL)
  SELECT wg.qid, wg.ev, k::INT AS k, coalesce((max(shared) FILTER (WHERE rank <= k)), 0) AS covered, len(any_value(g)) AS size
  FROM wg CROSS JOIN unnest([1, 5, 10]) AS u(k) LEFT JOIN sh ON sh.qid = wg.qid AND sh.ev = wg.ev GROUP BY ALL""",
    "union_coverage": BUDGET_SQL
    + f""", wt AS (SELECT qid, ev, {S.TOKENS.format('text')} AS w FROM ev), wl AS (SELECT qid, ev, unnest(list_distinct({S.sql_ngrams('w', 5)})) AS gram FROM wt),
  lt AS (SELECT qid, {_T} AS w FROM win), lg AS (SELECT DISTINCT qid, gram FROM (SELECT qid, unnest({S.sql_ngrams('w', 5)}) AS gram FROM lt))
  SELECT wl.qid, ev, count(lg.gram) AS covered, count(*) AS size FROM wl LEFT JOIN lg ON wl.qid = lg.qid AND wl.gram = lg.gram GROUP BY ALL""",
    "question_bootstrap": _ci_sql("qid"),
    "cluster_bootstrap": _ci_sql(_COMPANY),
    "reader_requests": _CONTEXTS
    + """, rq AS (SELECT qid, 'K0' AS kosul, 0::BIGINT AS n_words, '' AS pages, 'Question: ' || question || chr(10) || 'Answer from what you know. End with the line "Final answer:".' AS text FROM q WHERE question IS NOT NULL
    UNION ALL SELECT qid, kosul, n_words, array_to_string(list_transform(pages, lambda p: p.doc || ':' || p.page), ' '), 'Passages of filings follow, each under its document and page.' || chr(10) || chr(10) || context || chr(10) || chr(10)
      || 'Question: ' || question || chr(10) || 'Use the passages. End with the lines "Final answer:" and "Sources:" (document, page).' FROM q JOIN ctx USING (qid) WHERE question IS NOT NULL)
  SELECT qid, kosul, 'q1' AS version, n_words, pages, md5(text) AS text_md5 FROM rq""",
    "context_statistics": _CONTEXTS
    + """, gp AS (SELECT qid, list(DISTINCT {'doc': doc, 'page': page}) AS gold FROM ev WHERE doc IS NOT NULL AND page IS NOT NULL GROUP BY qid),
  cs AS (SELECT kosul, n_words, len(list_intersect(gold, pages)) / len(gold) AS share FROM ctx JOIN gp USING (qid))
  SELECT kosul, count(*) AS n, round(avg(n_words), 6) AS mean_words, round(avg((share > 0)::INT), 6) AS any_page, round(avg(share), 6) AS page_share FROM cs GROUP BY kosul""",
    "window_pages": BUDGET_SQL + " SELECT count(*) AS n, round(avg(pages), 6) AS mean_pages FROM (SELECT qid, count(*) AS pages FROM seen GROUP BY qid)",
    "question_record": _RECORD + " SELECT * FROM rec",
    "macro_recall": _RECORD + " SELECT count(*) AS questions, round(avg(hit_at_5 / n), 6) AS hit_at_5, round(avg(hit_at_10 / n), 6) AS hit_at_10, round(avg(in_window / n), 6) AS in_window, round(avg(page_share), 6) AS page_share FROM rec",
    "error_analysis": _HITS
    + """, sz AS (SELECT qid, least(count(*), 3)::VARCHAR AS n FROM ev GROUP BY qid),
  ea AS (SELECT coalesce(hit <= 5, false) AS found, round(length(regexp_replace(coalesce(ev.text, ''), '[^0-9]', '', 'g')) / greatest(length(coalesce(ev.text, '')), 1), 3) AS digits, coalesce(question_type, '-') AS kind, sz.n AS n
    FROM ev JOIN hits USING (qid, ev) JOIN q USING (qid) JOIN sz USING (qid)),
  eb AS (SELECT 'kind' AS "by", kind AS value, found, digits FROM ea UNION ALL SELECT 'rows', n, found, digits FROM ea)
  SELECT "by", value, count(*) FILTER (WHERE found) AS found, count(*) AS n, round(quantile_cont(digits, 0.5) FILTER (WHERE found), 6) AS digits_found, round(quantile_cont(digits, 0.5) FILTER (WHERE NOT found), 6) AS digits_missed FROM eb GROUP BY ALL""",
    "paired_delta": _delta_sql("company"),
    "paired_delta_questions": _delta_sql("qid"),
    "paired_delta_values": _delta_sql("company", share=True),
}
