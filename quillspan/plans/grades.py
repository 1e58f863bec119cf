"""Queries that grade answers: numbers, verdicts, key numbers, their merge and accuracy tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import grading
from quillspan.plans import evaluation
from quillspan.plans import shared as S
from quillspan.plans.answer_sql import GOLD_TYPE, OK, UNIT, numbers_sql, parts_sql, rounded_sql, verdict_sql
from quillspan.operators.ranking import ranked
from quillspan.plans.answers import CELL, blind_assignment, latest_success
from quillspan.sources.tables import table


def number_extraction(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "sorular", "kayit_no", "answer").where("answer IS NOT NULL")
    n = q.select("kayit_no", F.posexplode(T.numbers(F.col("answer"))).alias("place", "n"))
    return n.select("kayit_no", "place", "n.*")


def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Candidate numbers of the final answers, and whether each is a bare year."""
    a = table(spark, d, "cevaplar", "kayit_no", "yanit").where("yanit IS NOT NULL")
    n = a.select("kayit_no", F.posexplode(T.numbers(T.final_answer(F.col("yanit")))).alias("place", "n"))
    return n.select("kayit_no", "place", "n.*", grading.bare_year(F.col("n")).alias("bare_year"))


def verdict_grades(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on yes-or-no questions by model and condition, over the latest sound answers; no verdict is wrong."""
    gold = _golds(spark, d).where(T.gold_type(F.col("gold")) == "verdict").select("id", T.verdict(F.trim("gold")).alias("gold"))
    a = latest_success(spark, d).withColumn("given", T.verdict(T.final_answer(F.col("yanit")))).join(gold, "id")
    right = F.when(F.col("given") == F.col("gold"), 1).otherwise(0)
    return a.groupBy("model", "kosul").agg(F.sum(right).alias("correct"), F.count("given").alias("answered"), F.count(F.lit(1)).alias("n"))


def number_grades(spark: SparkSession, d: str) -> DataFrame:
    a = latest_success(spark, d).join(_golds(spark, d).where(T.gold_type(F.col("gold")) == "number"), "id")
    g = a.select("model", "kosul", grading.number_grade(F.col("gold"), T.final_answer(F.col("yanit")), F.col("question")).alias("g"))
    yes = lambda c: F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0)))
    return g.groupBy("model", "kosul").agg(yes("g.precise").alias("precise"), yes("g.tolerant").alias("tolerant"), F.count(F.lit(1)).alias("n"))


def _key_number_cells(a: DataFrame) -> DataFrame:
    """Mean share and all-found share of (model, kosul, gold, yanit) by model and condition; gold without key numbers is left out."""
    g = a.select("model", "kosul", grading.key_number_grade(F.col("gold"), F.col("yanit")).alias("g")).where("g IS NOT NULL")
    share, everything = F.round(F.avg("g.share"), 6), F.round(F.avg(F.col("g.everything").cast("int")), 6)
    return g.groupBy("model", "kosul").agg(share.alias("mean_share"), everything.alias("all_found"), F.count(F.lit(1)).alias("n"))


def key_number_grades(spark: SparkSession, d: str) -> DataFrame:
    """Answers to questions whose gold answer is a text with numbers: the share of its key numbers that they repeat."""
    gold = _golds(spark, d).where(T.gold_type(F.col("gold")) == "key_number")
    return _key_number_cells(latest_success(spark, d).join(gold, "id"))


def key_number_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The same against every evidence text of a question."""
    e = S.evidence(spark, d).where("text IS NOT NULL").select(F.col("qid").alias("id"), F.col("text").alias("gold"))
    return _key_number_cells(latest_success(spark, d).join(e, "id"))


def gold_key_numbers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "sorular", "kayit_no", "answer").where(T.gold_type(F.col("answer")) == "key_number")
    n = q.select("kayit_no", F.posexplode(grading.key_numbers(F.col("answer"))).alias("place", "n"))
    return n.select("kayit_no", "place", (F.col("n.value") * F.col("n.scale")).alias("value"), "n.decimals", "n.percent", "n.scale")


def _golds(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).where("answer IS NOT NULL").select(F.col("qid").alias("id"), F.col("answer").alias("gold"), "question", "question_type", "doc")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """One row for every question with a gold answer in every cell of model, condition and prompt: missing answers are rows too."""
    last = latest_success(spark, d)
    cells = table(spark, d, "cevaplar", *CELL[1:]).where("model IS NOT NULL AND kosul IS NOT NULL AND prompt_surum IS NOT NULL").distinct()
    asked = _golds(spark, d).crossJoin(cells)  # a few cells, each for every question: the operator's own product
    a = asked.join(last, CELL, "left").withColumn("g", grading.grade(F.col("gold"), F.col("yanit"), F.col("question")))
    return a.select(*CELL, "question_type", "doc", "gold", "question", "yanit", F.col("yanit").isNotNull().alias("answered"), F.col("g.kind").alias("gold_type"), F.col("g.correct").alias("correct"), "g.tolerant")


def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).drop("question_type", "doc", "gold", "question", "yanit")


def for_judges(spark: SparkSession, d: str) -> DataFrame:
    """How many answers no rule can grade, by cell and kind of gold: what people or a judge would have to read."""
    g = _graded(spark, d).where("correct IS NULL AND answered")
    return g.groupBy(*CELL[1:], "gold_type").agg(F.count(F.lit(1)).alias("n"))


def judge_items(spark: SparkSession, d: str) -> DataFrame:
    """The answers that no rule can grade, one a row: what a judge is shown of question, gold, final answer and body (as md5)."""
    g = _graded(spark, d).where("correct IS NULL AND answered")
    shown = {"question": F.col("question"), "gold": F.col("gold"), "final": T.final_answer(F.col("yanit")), "body": T.without_sources(F.col("yanit"))}
    return g.select(*CELL, *[F.md5(c).alias(f"{name}_md5") for name, c in shown.items()])


def judge_sample(spark: SparkSession, d: str) -> DataFrame:
    """A balanced sample of graded answers to try a judge on: 4 correct, 3 wrong and 1 partial (near the gold number only), the
    first by a hash of their key."""
    grade = F.when(F.col("correct") == 1, "correct").when(F.col("tolerant") == 1, "partial").otherwise("wrong")
    g = _graded(spark, d).where("correct IS NOT NULL AND answered").select(grade.alias("grade"), *CELL)
    quota = F.when(F.col("grade") == "correct", 4).when(F.col("grade") == "wrong", 3).otherwise(1)
    return ranked(g, ["grade"], [F.asc(F.sha2(F.concat_ws("|", *CELL), 256)), *map(F.asc, CELL)], 4).where(F.col("rank") <= quota)


def blind_scores(spark: SparkSession, d: str) -> DataFrame:
    """Yes-or-no answers graded by place and letter alone, then joined with the key to their model and condition; answers
    whose place and letter got no grade are counted as missing."""
    key = blind_assignment(spark, d)
    seen = latest_success(spark, d).select("kayit_no", T.verdict(T.final_answer(F.col("yanit"))).alias("said"))
    sheet = key.join(seen, "kayit_no").select("place", "letter", "said")
    golds = _golds(spark, d).where(T.gold_type(F.col("gold")) == "verdict").select(F.md5(F.concat_ws("|", F.lit("42"), "id")).alias("place"), T.verdict(F.trim("gold")).alias("gold"))
    graded = sheet.join(golds, "place").select("place", "letter", F.coalesce((F.col("said") == F.col("gold")).cast("int"), F.lit(0)).alias("correct"))
    return key.join(graded, ["place", "letter"], "left").groupBy("model", "kosul").agg(F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct"), F.count("correct").alias("n"), F.count(F.when(F.col("correct").isNull(), 1)).alias("missing"))


def locked_drift(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on development questions and on those of the held-out third of companies, and the difference, by cell."""
    g = _graded(spark, d).where("correct IS NOT NULL").withColumn("held", S.locked(S.company(F.col("doc"), F.col("id"))))
    mean = lambda held: F.avg(F.when(F.col("held") == held, F.col("correct")))
    count = lambda held: F.count(F.when(F.col("held") == held, 1))
    return g.groupBy(*CELL[1:]).agg(count(False).alias("n_development"), count(True).alias("n_locked"), F.round(mean(False), 6).alias("development"), F.round(mean(True), 6).alias("locked"), F.round(mean(True) - mean(False), 6).alias("drift"))


def accuracy_table(spark: SparkSession, d: str) -> DataFrame:
    """Correct and all answers that rules can grade, by cell, kind of gold and kind of question; missing answers count as wrong."""
    g = _graded(spark, d).where("correct IS NOT NULL")
    return g.groupBy(*CELL[1:], "gold_type", "question_type").agg(F.sum("correct").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("answered"), 1)).alias("missing"))


def common_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each model and condition on the questions that are answered and graded in all of them, so that they compare; of
    several prompts the last counts."""
    g = _graded(spark, d).where("correct IS NOT NULL AND answered").groupBy("id", "model", "kosul").agg(F.max_by("correct", "prompt_surum").alias("correct"))
    cells = g.select("model", "kosul").distinct().agg(F.count(F.lit(1)).alias("cells"))
    full = g.groupBy("id").agg(F.count(F.lit(1)).alias("n")).crossJoin(cells).where("n = cells").select("id")
    return g.join(full, "id", "left_semi").groupBy("model", "kosul").agg(F.sum("correct").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("n"))


def context_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by condition where an evidence page is in the question's context of 1000 words, and where none is."""
    g = _graded(spark, d).where("correct IS NOT NULL").join(evaluation.context_hit(spark, d).select(F.col("qid").alias("id"), F.col("hit").alias("present")), "id")
    return g.groupBy("kosul", "present").agg(F.sum("correct").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("n"))


def accuracy_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on golds that are one number, by condition and the years of the filing: up to 2019, 2020 to 2021, later."""
    docs = table(spark, d, "belgeler", "doc_name", "doc_period").where("doc_name IS NOT NULL AND doc_period IS NOT NULL").groupBy(F.col("doc_name").alias("doc")).agg(F.min("doc_period").alias("year"))
    bucket = F.when(F.col("year") <= 2019, "to 2019").when(F.col("year") <= 2021, "2020-2021").otherwise("from 2022")
    g = _graded(spark, d).where("gold_type = 'number'").join(docs, "doc").withColumn("years", bucket)
    return g.groupBy("kosul", "years").agg(F.sum("correct").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("n"))


def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    """What was answered to yes-or-no questions by cell: yes, no or neither; and how often always-yes would be right."""
    gold = _golds(spark, d).where(T.gold_type(F.col("gold")) == "verdict").select("id", T.verdict(F.trim("gold")).alias("gold"))
    a = latest_success(spark, d).join(gold, "id").withColumn("said", F.coalesce(T.verdict(T.final_answer(F.col("yanit"))), F.lit("other")))
    return a.groupBy(*CELL[1:], "said").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gold") == "yes", 1)).alias("gold_yes"))


QUERIES = {
    f.__name__: f
    for f in (
        number_extraction, answer_numbers, verdict_grades, number_grades, key_number_grades, key_number_evidence, gold_key_numbers, graded_answers, for_judges, judge_items, judge_sample, blind_scores, locked_drift, accuracy_table, common_accuracy, context_accuracy,
        accuracy_by_year, verdict_distribution,
    )
}


_TRIMMED = "trim(answer, ' ')"
_BARE = "decimals = 0 AND NOT percent AND scale = 1 AND value BETWEEN 1900 AND 2100"
_COUNTS = "NOT (decimals = 0 AND NOT percent AND scale = 1 AND (abs(value) < 100 OR abs(value) BETWEEN 1900 AND 2100))"


def _number_sql(answers: str) -> str:
    """CTE ``ng`` (key, precise, tolerant): the grade of every answer in ``answers`` (key, id, final) to a gold that is one number."""
    return f"""gd AS (SELECT qid AS id, answer, {UNIT} AS unit FROM q WHERE {GOLD_TYPE} = 'number'), {numbers_sql('gn', 'gd', 'id', 'answer')},
  ga AS (SELECT a.key, a.final, gn.value AS g_value, gn.decimals AS g_decimals, gn.percent AS g_percent, gn.dollar AS g_dollar, gn.scale AS g_scale,
    CASE gd.unit WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 END AS unit FROM {answers} a JOIN gd USING (id) JOIN gn ON gn.key = a.id AND gn.place = 0),
  {numbers_sql('an', 'ga', 'key', 'final')},
  cn AS (SELECT an.*, ga.* EXCLUDE (key, final), {_BARE} AS bare, g_decimals = 0 AND NOT g_percent AND g_scale = 1 AND g_value BETWEEN 1900 AND 2100 AS g_bare FROM an JOIN ga USING (key)),
  ck AS (SELECT * FROM cn QUALIFY g_bare OR NOT bare OR bool_and(bare) OVER (PARTITION BY key)),
  cb AS (SELECT *, CASE WHEN unit IS NOT NULL AND scale <> 1 THEN value * scale / unit ELSE value END AS v FROM ck
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY (dollar = g_dollar)::INT + (percent = g_percent)::INT + ((decimals > 0) = (g_decimals > 0))::INT DESC, place) = 1),
  ng AS (SELECT key, ({rounded_sql('v', 'g_decimals')}) = ({rounded_sql('g_value', 'g_decimals')}) AS precise,
    CASE WHEN g_value = 0 THEN abs(v) <= 0.005 ELSE abs(v - g_value) <= 0.01 * abs(g_value) END AS tolerant FROM cb)"""


def _key_sql(golds: str, answers: str) -> str:
    """CTE ``kg`` (key, gkey, share, everything): the share of the key numbers of each gold in ``golds`` (gkey, id, gold) that each answer
    in ``answers`` (key, id, body) to its question has."""
    return f"""kd AS (SELECT * FROM {golds}), {numbers_sql('kn', 'kd', 'gkey', 'gold')}, kc AS (SELECT kd.id, kn.* FROM kn JOIN kd ON kd.gkey = kn.key WHERE {_COUNTS}),
  {numbers_sql('kb', answers, 'key', 'body')},
  kp AS (SELECT a.key, kc.key AS gkey, kc.place, kc.value, kc.scale, kc.decimals FROM {answers} a JOIN kc ON kc.id = a.id),
  km AS (SELECT kp.key, kp.gkey, kp.place, bool_or(coalesce(({rounded_sql('kb.value * kb.scale / kp.scale', 'kp.decimals')}) = ({rounded_sql('kp.value', 'kp.decimals')})
    OR (kp.value <> 0 AND abs(kb.value * kb.scale - kp.value * kp.scale) <= 0.01 * abs(kp.value * kp.scale)), false)) AS met FROM kp LEFT JOIN kb ON kb.key = kp.key GROUP BY ALL),
  kg AS (SELECT key, gkey, count(*) FILTER (WHERE met) / count(*) AS share, bool_and(met) AS everything FROM km GROUP BY ALL)"""


_ANSWERS = f"{OK}, {parts_sql('latest')}, ans AS (SELECT kayit_no AS key, id, kosul, model, prompt_surum, body, final FROM pt)"
_LATEST = f"WITH {S.QUESTIONS}, {_ANSWERS}"
_KEY_CELLS = "SELECT model, kosul, round(avg(share), 6) AS mean_share, round(avg(everything::INT), 6) AS all_found, count(*) AS n FROM kg JOIN ans USING (key) GROUP BY ALL"
_KEY_GOLD = f"kgold AS (SELECT qid AS gkey, qid AS id, answer AS gold FROM q WHERE {GOLD_TYPE} = 'key_number')"
_GRADES = f"""{_ANSWERS}, {_KEY_GOLD}, {_number_sql('ans')}, {_key_sql('kgold', 'ans')},
  cells AS (SELECT DISTINCT kosul, model, prompt_surum FROM cevaplar WHERE model IS NOT NULL AND kosul IS NOT NULL AND prompt_surum IS NOT NULL),
  wanted AS (SELECT qid AS id, doc, question_type, {GOLD_TYPE} AS gold_type, {verdict_sql(_TRIMMED)} AS said, cells.* FROM q, cells WHERE answer IS NOT NULL),
  keyed AS (SELECT DISTINCT id FROM kc),
  graded AS (SELECT w.id, w.kosul, w.model, w.prompt_surum, w.doc, w.question_type, a.key IS NOT NULL AS answered, w.gold_type,
    CASE w.gold_type WHEN 'number' THEN coalesce(ng.precise, false)::INT WHEN 'verdict' THEN coalesce({verdict_sql('a.final')} = w.said, false)::INT
      WHEN 'key_number' THEN CASE WHEN keyed.id IS NOT NULL THEN coalesce(kg.everything, false)::INT END END AS correct,
    CASE w.gold_type WHEN 'number' THEN coalesce(ng.tolerant, false)::INT END AS tolerant
    FROM wanted w LEFT JOIN ans a ON a.id = w.id AND a.kosul = w.kosul AND a.model = w.model AND a.prompt_surum = w.prompt_surum LEFT JOIN ng ON ng.key = a.key LEFT JOIN kg ON kg.key = a.key LEFT JOIN keyed ON keyed.id = w.id)"""
_GRADED = f"WITH {S.QUESTIONS}, {_GRADES}"
_CELL = "kosul, model, prompt_surum"
_YESNO = f"vg AS (SELECT qid AS id, {verdict_sql(_TRIMMED)} AS gold FROM q WHERE {GOLD_TYPE} = 'verdict'), va AS (SELECT ans.*, vg.gold, {verdict_sql('final')} AS given FROM ans JOIN vg USING (id))"

SQL = {
    "number_extraction": f"WITH s AS (SELECT kayit_no, answer FROM sorular WHERE answer IS NOT NULL), {numbers_sql('n', 's', 'kayit_no', 'answer')} SELECT key AS kayit_no, place, value, decimals, percent, scale, dollar FROM n",
    "answer_numbers": f"WITH {parts_sql('(SELECT kayit_no, yanit FROM cevaplar WHERE yanit IS NOT NULL)')}, {numbers_sql('n', 'pt', 'kayit_no', 'final')} SELECT key AS kayit_no, place, value, decimals, percent, scale, dollar, {_BARE} AS bare_year FROM n",
    "verdict_grades": f"{_LATEST}, {_YESNO} SELECT model, kosul, sum(CASE WHEN given = gold THEN 1 ELSE 0 END)::BIGINT AS correct, count(given) AS answered, count(*) AS n FROM va GROUP BY ALL",
    "number_grades": f"""{_LATEST}, {_number_sql('ans')} SELECT model, kosul, sum(coalesce(precise, false)::INT)::BIGINT AS precise, sum(coalesce(tolerant, false)::INT)::BIGINT AS tolerant, count(*) AS n
        FROM ans JOIN gd USING (id) LEFT JOIN ng USING (key) GROUP BY ALL""",
    "key_number_grades": f"{_LATEST}, {_KEY_GOLD}, {_key_sql('kgold', 'ans')} {_KEY_CELLS}",
    "key_number_evidence": f"WITH {S.EVIDENCE}, {_ANSWERS}, kgold AS (SELECT qid || '|' || ev AS gkey, qid AS id, text AS gold FROM ev WHERE text IS NOT NULL), {_key_sql('kgold', 'ans')} {_KEY_CELLS}",
    "gold_key_numbers": f"WITH s AS (SELECT kayit_no, answer FROM sorular WHERE {GOLD_TYPE} = 'key_number'), {numbers_sql('n', 's', 'kayit_no', 'answer')} SELECT key AS kayit_no, (row_number() OVER (PARTITION BY key ORDER BY place) - 1)::INT AS place, value * scale AS value, decimals, percent, scale FROM n WHERE {_COUNTS}",
    "graded_answers": f"{_GRADED} SELECT * EXCLUDE (doc, question_type) FROM graded",
    "for_judges": f"{_GRADED} SELECT {_CELL}, gold_type, count(*) AS n FROM graded WHERE correct IS NULL AND answered GROUP BY ALL",
    "judge_items": f"""{_GRADED} SELECT g.id, g.kosul, g.model, g.prompt_surum, md5(q.question) AS question_md5, md5(q.answer) AS gold_md5, md5(a.final) AS final_md5, md5(a.body) AS body_md5
        FROM graded g JOIN q ON q.qid = g.id JOIN ans a ON a.id = g.id AND a.kosul = g.kosul AND a.model = g.model AND a.prompt_surum = g.prompt_surum WHERE g.correct IS NULL AND g.answered""",
    "judge_sample": f"""{_GRADED}, gr AS (SELECT CASE WHEN correct = 1 THEN 'correct' WHEN tolerant = 1 THEN 'partial' ELSE 'wrong' END AS grade, id, kosul, model, prompt_surum FROM graded WHERE correct IS NOT NULL AND answered)
        SELECT *, row_number() OVER (PARTITION BY grade ORDER BY sha256(concat_ws('|', id, {_CELL})), id, {_CELL})::INT AS rank FROM gr QUALIFY rank <= CASE grade WHEN 'correct' THEN 4 WHEN 'wrong' THEN 3 ELSE 1 END""",
    "blind_scores": f"""{_LATEST}, vg AS (SELECT qid AS id, {verdict_sql(_TRIMMED)} AS gold FROM q WHERE {GOLD_TYPE} = 'verdict')
        SELECT model, kosul, sum(CASE WHEN {verdict_sql('final')} = gold THEN 1 ELSE 0 END)::BIGINT AS correct, count(gold) AS n, count(*) - count(gold) AS missing
        FROM ans LEFT JOIN vg USING (id) GROUP BY ALL""",
    "locked_drift": f"""{_GRADED}, gl AS (SELECT *, {S.LOCKED.format('id')} AS held FROM graded WHERE correct IS NOT NULL)
        SELECT {_CELL}, count(*) FILTER (WHERE NOT held) AS n_development, count(*) FILTER (WHERE held) AS n_locked, round(avg(correct) FILTER (WHERE NOT held), 6) AS development, round(avg(correct) FILTER (WHERE held), 6) AS locked,
        round(avg(correct) FILTER (WHERE held) - avg(correct) FILTER (WHERE NOT held), 6) AS drift FROM gl GROUP BY ALL""",
    "accuracy_table": f"{_GRADED} SELECT {_CELL}, gold_type, question_type, sum(correct)::BIGINT AS correct, count(*) AS n, count(*) FILTER (WHERE NOT answered) AS missing FROM graded WHERE correct IS NOT NULL GROUP BY ALL",
    "common_accuracy": f"""{_GRADED}, gg AS (SELECT id, model, kosul, arg_max(correct, prompt_surum) AS correct FROM graded WHERE correct IS NOT NULL AND answered GROUP BY ALL),
        full_ AS (SELECT id FROM gg GROUP BY id HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT model, kosul FROM gg)))
        SELECT model, kosul, sum(correct)::BIGINT AS correct, count(*) AS n FROM gg SEMI JOIN full_ USING (id) GROUP BY ALL""",
    "context_accuracy": f"""{evaluation.BUDGET_SQL}, {_GRADES}, ch AS (SELECT ev.qid AS id, count(s.qid) > 0 AS present FROM ev LEFT JOIN seen s ON s.qid = ev.qid AND s.doc = ev.doc AND s.page = ev.page GROUP BY ev.qid)
        SELECT kosul, present, sum(correct)::BIGINT AS correct, count(*) AS n FROM graded JOIN ch USING (id) WHERE correct IS NOT NULL GROUP BY ALL""",
    "accuracy_by_year": f"""{_GRADED}, dy AS (SELECT doc_name AS doc, min(doc_period) AS year FROM belgeler WHERE doc_name IS NOT NULL AND doc_period IS NOT NULL GROUP BY 1)
        SELECT kosul, CASE WHEN year <= 2019 THEN 'to 2019' WHEN year <= 2021 THEN '2020-2021' ELSE 'from 2022' END AS years, sum(correct)::BIGINT AS correct, count(*) AS n FROM graded JOIN dy USING (doc) WHERE gold_type = 'number' GROUP BY ALL""",
    "verdict_distribution": f"{_LATEST}, {_YESNO} SELECT {_CELL}, coalesce(given, 'other') AS said, count(*) AS n, count(*) FILTER (WHERE gold = 'yes') AS gold_yes FROM va GROUP BY ALL",
}
