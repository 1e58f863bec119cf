"""Queries on answers: latest records, grades, citations, samples; and on questions: types, units, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import grading, routing
from quillspan.operators.ranking import ranked
from quillspan.plans import evaluation
from quillspan.plans import routing_sql
from quillspan.plans import shared as S
from quillspan.plans.answer_sql import GOLD_TYPE, OK, UNIT, parts_sql, verdict_sql
from quillspan.sources.tables import table

CELL = ["id", "kosul", "model", "prompt_surum"]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cevaplar", "kayit_no", *CELL, "tarih", "yanit", "hata")


def latest_success(spark: SparkSession, d: str) -> DataFrame:
    """The last record without an error of each question, condition, model and prompt."""
    ok = _answers(spark, d).where("hata IS NULL AND yanit IS NOT NULL")
    last = ranked(ok, CELL, [F.desc(F.coalesce("tarih", F.lit("0001-01-01").cast("timestamp"))), F.desc("kayit_no")], 1)
    return last.select("kayit_no", *CELL, "yanit")


def latest_success_keys(spark: SparkSession, d: str) -> DataFrame:
    return latest_success(spark, d).drop("yanit")


def missing_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions and conditions without any sound record: what a resumed run would still have to ask. Every question is wanted
    under each of the few conditions that answers have."""
    wanted = S.questions(spark, d).select(F.col("qid").alias("id")).crossJoin(table(spark, d, "cevaplar", "kosul").where("kosul IS NOT NULL").distinct())
    return wanted.join(_answers(spark, d).where("hata IS NULL AND yanit IS NOT NULL"), ["id", "kosul"], "left_anti")


def request_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One hash of everything that a request depends on: of JSON with sorted keys, in which nulls are kept apart."""
    a = _answers(spark, d).join(S.questions(spark, d).select(F.col("qid").alias("id"), "question"), "id")
    request = F.to_json(F.struct(*sorted([*CELL, "question"])), {"ignoreNullFields": "false"})
    return a.select("kayit_no", F.sha2(request, 256).alias("fingerprint"))


def gold_types(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "sorular", "kayit_no", "question", "answer")
    return q.select("kayit_no", T.gold_type(F.col("answer")).alias("gold_type"), T.expected_unit(F.col("question")).alias("unit"))


def final_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cevaplar", "kayit_no", "yanit").where("yanit IS NOT NULL")
    return a.select("kayit_no", T.final_answer(F.col("yanit")).alias("final"))


def insufficiency_flags(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cevaplar", "model", "kosul", "yanit").where("yanit IS NOT NULL")
    return a.groupBy("model", "kosul").agg(F.sum(F.col("yanit").rlike(T.INSUFFICIENT).cast("int")).cast("bigint").alias("flagged"), F.count(F.lit(1)).alias("n"))


def common_graded(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a sound answer in every model and condition."""
    a = _answers(spark, d).where("hata IS NULL AND yanit IS NOT NULL").select("id", "model", "kosul").distinct()
    every = a.select("model", "kosul").distinct().agg(F.count(F.lit(1)).alias("every"))  # one row
    return a.groupBy("id").agg(F.count(F.lit(1)).alias("cells")).crossJoin(every).where("cells = every").select("id", "cells")


def yes_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Gold answers that open with yes or no, by which: the accuracy of always saying one of them."""
    gold = S.questions(spark, d).where(T.gold_type(F.col("answer")) == "verdict").select(T.verdict(F.trim("answer")).alias("gold"))
    return gold.groupBy("gold").agg(F.count(F.lit(1)).alias("n"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    a = latest_success(spark, d)
    return a.select(F.col("kayit_no").alias("record"), F.col("id").alias("qid"), "model", "kosul", T.citations(F.col("yanit")).alias("pages"))


def citation_pages(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("record", F.posexplode("pages").alias("place", "p")).select("record", "place", "p.doc", "p.page")


def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cited pages of each answer, those that hold evidence, and those in the question's context of 1000 words."""
    return grading.citation_scores(_cited(spark, d).select("record", "qid", "pages"), S.evidence(spark, d), evaluation.context_pages(spark, d))


def citation_rollup(spark: SparkSession, d: str) -> DataFrame:
    cells = latest_success(spark, d).select(F.col("kayit_no").alias("record"), "model", "kosul")
    scored = citation_scores(spark, d).join(cells, "record").groupBy("model", "kosul")
    return scored.agg(
        F.count(F.when(F.col("n_cited") == 0, 1)).alias("without"), F.count(F.when(F.col("n_right") > 0, 1)).alias("hits"), F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.when(F.col("n_cited") > 0, F.col(c) / F.col("n_cited"))), 6).alias(name) for c, name in (("n_right", "precision"), ("n_seen", "in_context"))],
    )


def pilot_first4(spark: SparkSession, d: str) -> DataFrame:
    return ranked(S.questions(spark, d).select("question_type", "qid"), ["question_type"], [F.asc("qid")], 4)


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fixed number of answers for each way of ending, the first by a hash of the key: 4, 3 and 1, then 2."""
    a = table(spark, d, "cevaplar", "kayit_no", "bitis_nedeni").withColumn("ending", F.coalesce(F.regexp_replace("bitis_nedeni", r"^FinishReason\.", ""), F.lit("none")))
    quota = F.when(F.col("ending") == "STOP", 4).when(F.col("ending") == "MAX_TOKENS", 3).when(F.col("ending") == "none", 1).otherwise(2)
    order = [F.asc(F.sha2(F.col("kayit_no").cast("string"), 256))]
    return ranked(a, ["ending"], order, 4).where(F.col("rank") <= quota).select("ending", "kayit_no", "rank")


def blind_assignment(spark: SparkSession, d: str) -> DataFrame:
    """A letter for each answer of a question, in an order that shows neither model, condition nor prompt; after Z the letters
    begin again with a number (A2). ``place`` hides the order of the questions in the same way. Key of the assignment: kayit_no."""
    order = F.md5(F.concat_ws("|", F.lit("42"), *CELL))
    a = latest_success(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1)
    again = F.when(F.col("n") >= 26, F.floor(F.col("n") / 26).cast("int") + 1).cast("string")
    letter = F.concat(F.char(F.lit(65) + F.col("n") % 26), F.coalesce(again, F.lit("")))
    return a.select("kayit_no", *CELL, letter.alias("letter"), F.md5(F.concat_ws("|", F.lit("42"), "id")).alias("place"))


def blind_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a blind reader sees of each answer: question, letter and the text without its sources; not who gave it."""
    seen = latest_success(spark, d).select("kayit_no", T.without_sources(F.col("yanit")).alias("text"))
    return blind_assignment(spark, d).join(seen, "kayit_no").select("place", "letter", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def rescore_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Cells answered more than once: how often the first and the last final answer agree, by model."""
    ok = _answers(spark, d).where("hata IS NULL AND yanit IS NOT NULL").withColumn("final", T.final_answer(F.col("yanit")))
    ends = ok.groupBy(*CELL).agg(F.min_by("final", "kayit_no").alias("a"), F.max_by("final", "kayit_no").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ends.groupBy("model").agg(F.count(F.lit(1)).alias("common"), F.sum((F.col("a") == F.col("b")).cast("int")).cast("bigint").alias("same"))


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cevaplar", "model", "kullanim", "maliyet_usd")
    return a.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("kullanim.girdi").alias("tokens_in"), F.sum("kullanim.cikti").alias("tokens_out"), F.round(F.avg("kullanim.dusunme"), 6).alias("mean_thinking"), F.round(F.sum("maliyet_usd"), 6).alias("cost"))


#: First calls of each model and condition that a latency summary leaves out.
WARM_UPS = 3


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile (lower rank) of the seconds of a call in hundredths, by model and condition, after three
    warm-ups. Calls are counted by hundredths first, so ranks are running sums over these, however many calls there are."""
    cell = ["model", "kosul"]
    a = table(spark, d, "cevaplar", "kayit_no", *cell, "tarih", "sure_sn").where("sure_sn IS NOT NULL")
    warm = ranked(a, cell, [F.asc_nulls_last("tarih"), F.asc("kayit_no")], WARM_UPS).select("kayit_no")
    t = a.join(warm, "kayit_no", "left_anti").groupBy(*cell, F.round("sure_sn", 2).alias("s")).agg(F.count(F.lit(1)).alias("times"))
    upto = Window.partitionBy(*cell).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("upto", F.sum("times").over(upto)).withColumn("all", F.sum("times").over(Window.partitionBy(*cell)))
    low = F.min(F.when(F.col("upto") > F.floor(F.lit(0.95) * (F.col("all") - 1)), F.col("s")))
    return t.groupBy(*cell).agg(F.sum("times").alias("calls"), F.round(F.percentile("s", F.lit(0.5), F.col("times")), 6).alias("median"), low.alias("p95_low"))


def present_absent(spark: SparkSession, d: str) -> DataFrame:
    """Yes-or-no accuracy where an evidence page was cited, and where none was."""
    gold = S.questions(spark, d).where(T.gold_type(F.col("answer")) == "verdict").select("qid", T.verdict(F.trim("answer")).alias("gold"))
    given = latest_success(spark, d).select(F.col("kayit_no").alias("record"), T.verdict(T.final_answer(F.col("yanit"))).alias("given"))
    scores = grading.citation_scores(_cited(spark, d).select("record", "qid", "pages"), S.evidence(spark, d))
    a = scores.join(gold, "qid").join(given, "record").withColumn("present", F.col("n_right") > 0)
    return a.groupBy("present").agg(F.sum(F.when(F.col("given") == F.col("gold"), 1).otherwise(0)).alias("correct"), F.count(F.lit(1)).alias("n"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "belgeler", "doc_name", "company", "doc_period").where("doc_name IS NOT NULL").distinct()


def company_mentions(spark: SparkSession, d: str) -> DataFrame:
    return routing.mentions(S.questions(spark, d).select("qid", "question"), _catalog(spark, d))


def company_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first rule alone: all documents of the companies that a question names."""
    return routing.company_documents(S.questions(spark, d).select("qid", "question"), _catalog(spark, d)).select("qid", "doc_name").distinct()


def routed_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best 100 chunks of the documents that each question is routed to; of all where it is routed nowhere."""
    scored = S.scores(spark, d).join(S.chunks(spark, d).select("chunk_id", "doc"), "chunk_id")
    return routing.routed_ranking(scored, routed_documents(spark, d)).select("qid", "chunk_id", "rank")


def routed_documents(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(S.questions(spark, d).select("qid", "question"), _catalog(spark, d))


def question_years(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).select("qid", F.explode(T.fiscal_years(F.col("question"))).alias("year"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_success_keys, missing_answers, request_fingerprint, gold_types, final_answers, insufficiency_flags, common_graded, yes_baseline, citation_pages, citation_scores, citation_rollup, pilot_first4,
        quota_sample, blind_assignment, blind_answers, rescore_agreement, usage_totals, latency_summary, present_absent, company_mentions, company_documents, routed_documents, routed_ranking, question_years,
    )
}

_PARTS = f"{OK}, {parts_sql('latest')}"
_TRIMMED = "trim(answer, ' ')"
#: Cited pages (cp), their scores (cs) against evidence (gold) and the window (seen).
_CITED = rf"""cx AS (SELECT kayit_no AS record, id AS qid, model, kosul, final, regexp_extract_all(src, '(?i)([a-z0-9][a-z0-9_.\-]*)\s*,\s*(?:(?:sayfa|page|p)\b\.?)?[\s:]*([0-9]+)', 1) AS docs,
    regexp_extract_all(src, '(?i)([a-z0-9][a-z0-9_.\-]*)\s*,\s*(?:(?:sayfa|page|p)\b\.?)?[\s:]*([0-9]+)', 2) AS pages FROM pt),
  cp AS (SELECT record, qid, docs[i] AS doc, TRY_CAST(pages[i] AS INT) AS page, min(i) AS i FROM cx, unnest(range(1, len(docs) + 1)) AS u(i) GROUP BY ALL), gold AS (SELECT DISTINCT qid, doc, page FROM ev)"""
_SCORED = "cs AS (SELECT cx.record, any_value(cx.qid) AS qid, count(cp.doc) AS n_cited, count(gold.doc) AS n_right{0} FROM cx LEFT JOIN cp ON cx.record = cp.record LEFT JOIN gold ON gold.qid = cp.qid AND gold.doc = cp.doc AND gold.page = cp.page{1} GROUP BY cx.record)"
_SEEN = _SCORED.format(", count(seen.doc) AS n_seen", " LEFT JOIN seen ON seen.qid = cp.qid AND seen.doc = cp.doc AND seen.page = cp.page")
#: Letters in the hidden order; after Z they begin again with a number.
_BLIND = """bl AS (SELECT kayit_no, id, kosul, model, prompt_surum, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '42', id, kosul, model, prompt_surum))) - 1 AS n FROM latest),
  blind AS (SELECT *, chr((65 + n % 26)::INT) || CASE WHEN n >= 26 THEN (n // 26 + 1)::VARCHAR ELSE '' END AS letter, md5(concat_ws('|', '42', id)) AS place FROM bl)"""
_ROUTED = f"WITH {S.QUESTIONS}, {routing_sql.MENTIONS}, {routing_sql.ROUTE}"

SQL = {
    "latest_success_keys": f"WITH {OK} SELECT kayit_no, id, kosul, model, prompt_surum FROM latest",
    "missing_answers": f"""WITH {S.QUESTIONS}, {OK}, k AS (SELECT DISTINCT kosul FROM cevaplar WHERE kosul IS NOT NULL), w AS (SELECT qid AS id, kosul FROM q, k)
        SELECT w.id, w.kosul FROM w ANTI JOIN ok ON ok.id = w.id AND ok.kosul = w.kosul""",
    "request_fingerprint": f"WITH {S.QUESTIONS} SELECT c.kayit_no, sha256(to_json({{'id': id, 'kosul': kosul, 'model': model, 'prompt_surum': prompt_surum, 'question': question}})::VARCHAR) AS fingerprint FROM cevaplar c JOIN q ON q.qid = c.id",
    "gold_types": f"SELECT kayit_no, {GOLD_TYPE} AS gold_type, {UNIT} AS unit FROM sorular",
    "final_answers": f"WITH {parts_sql('(SELECT kayit_no, yanit FROM cevaplar WHERE yanit IS NOT NULL)')} SELECT kayit_no, final FROM pt",
    "insufficiency_flags": r"""SELECT model, kosul, sum(regexp_matches(yanit, '(?i)insufficient information|not enough information|cannot be determined|not disclosed|not available|unable to (determine|answer|confirm|state|derive|calculate)')::INT)::BIGINT AS flagged,
        count(*) AS n FROM cevaplar WHERE yanit IS NOT NULL GROUP BY ALL""",
    "common_graded": f"""WITH {OK}, a AS (SELECT DISTINCT id, model, kosul FROM ok), c AS (SELECT count(*) AS n FROM (SELECT DISTINCT model, kosul FROM a))
        SELECT id, count(*) AS cells FROM a GROUP BY id HAVING count(*) = (SELECT n FROM c)""",
    "yes_baseline": f"WITH {S.QUESTIONS} SELECT {verdict_sql(_TRIMMED)} AS gold, count(*) AS n FROM q WHERE {GOLD_TYPE} = 'verdict' GROUP BY 1",
    "citation_pages": f"WITH {S.EVIDENCE}, {_PARTS}, {_CITED} SELECT record, (row_number() OVER (PARTITION BY record ORDER BY i) - 1)::INT AS place, doc, page FROM cp",
    "citation_scores": f"{evaluation.BUDGET_SQL}, {_PARTS}, {_CITED}, {_SEEN} SELECT * FROM cs",
    "citation_rollup": f"""{evaluation.BUDGET_SQL}, {_PARTS}, {_CITED}, {_SEEN} SELECT model, kosul, count(*) FILTER (WHERE n_cited = 0) AS without, count(*) FILTER (WHERE n_right > 0) AS hits, count(*) AS n,
        round(avg(CASE WHEN n_cited > 0 THEN n_right / n_cited END), 6) AS precision, round(avg(CASE WHEN n_cited > 0 THEN n_seen / n_cited END), 6) AS in_context FROM cs JOIN cx USING (record) GROUP BY ALL""",
    "pilot_first4": f"WITH {S.QUESTIONS} SELECT question_type, qid, row_number() OVER (PARTITION BY question_type ORDER BY qid)::INT AS rank FROM q QUALIFY rank <= 4",
    "quota_sample": r"""WITH a AS (SELECT kayit_no, coalesce(regexp_replace(bitis_nedeni, '^FinishReason\.', ''), 'none') AS ending FROM cevaplar),
        r AS (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY sha256(kayit_no::VARCHAR))::INT AS rank FROM a)
        SELECT ending, kayit_no, rank FROM r WHERE rank <= CASE ending WHEN 'STOP' THEN 4 WHEN 'MAX_TOKENS' THEN 3 WHEN 'none' THEN 1 ELSE 2 END""",
    "blind_assignment": f"WITH {OK}, {_BLIND} SELECT kayit_no, id, kosul, model, prompt_surum, letter, place FROM blind",
    "blind_answers": f"WITH {_PARTS}, {_BLIND} SELECT place, letter, md5(body) AS text_md5, length(body)::INT AS chars FROM blind JOIN pt USING (kayit_no)",
    "rescore_agreement": f"""WITH {OK}, {parts_sql('ok')}, e AS (SELECT id, kosul, model, prompt_surum, arg_min(final, kayit_no) AS a, arg_max(final, kayit_no) AS b FROM pt GROUP BY ALL HAVING count(*) > 1)
        SELECT model, count(*) AS common, sum((a = b)::INT)::BIGINT AS same FROM e GROUP BY model""",
    "usage_totals": "SELECT model, count(*) AS calls, sum(kullanim.girdi)::BIGINT AS tokens_in, sum(kullanim.cikti)::BIGINT AS tokens_out, round(avg(kullanim.dusunme), 6) AS mean_thinking, round(sum(maliyet_usd), 6) AS cost FROM cevaplar GROUP BY model",
    "latency_summary": """WITH a AS (SELECT * FROM cevaplar WHERE sure_sn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model, kosul ORDER BY tarih NULLS LAST, kayit_no) > 3)
        SELECT model, kosul, count(*) AS calls, round(quantile_cont(round(sure_sn, 2), 0.5), 6) AS median, list_sort(list(round(sure_sn, 2)))[floor(0.95 * (count(*) - 1))::INT + 1] AS p95_low FROM a GROUP BY ALL""",
    "present_absent": f"""WITH {S.EVIDENCE}, {_PARTS}, {_CITED}, {_SCORED.format('', '')}, g AS (SELECT qid, {verdict_sql(_TRIMMED)} AS gold FROM q WHERE {GOLD_TYPE} = 'verdict'),
        a AS (SELECT n_right > 0 AS present, gold, {verdict_sql('final')} AS given FROM cs JOIN g USING (qid) JOIN cx USING (record))
        SELECT present, sum(CASE WHEN given = gold THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS n FROM a GROUP BY present""",
    "company_mentions": f"WITH {S.QUESTIONS}, {routing_sql.MENTIONS} SELECT qid, company FROM mention",
    "company_documents": f"{_ROUTED} SELECT DISTINCT qid, doc_name FROM found",
    "routed_documents": f"{_ROUTED} SELECT qid, doc_name, rule FROM routed",
    "routed_ranking": f"""{_ROUTED}, {S.SCORES}, {S.CHUNKS}, sc AS (SELECT score.*, chunk.doc FROM score JOIN chunk USING (chunk_id)),
        inside AS (SELECT sc.* FROM sc SEMI JOIN routed r ON r.qid = sc.qid AND r.doc_name = sc.doc UNION ALL SELECT * FROM sc WHERE qid NOT IN (SELECT qid FROM routed))
        SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM inside QUALIFY rank <= 100""",
    "question_years": f"WITH {S.QUESTIONS}, {routing_sql.YEARS} SELECT qid, year FROM years",
}
