"""Queries that audit training examples, a leak report and a split; and the streamed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import audit
from quillspan.plans import shared as S
from quillspan.sources.tables import table
from quillspan.streaming import log


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.company_years(table(spark, d, "finqa", "id", "bolum").distinct())


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "belgeler", "doc_name", "ticker", F.col("doc_period").alias("year")).where("ticker IS NOT NULL").distinct()


def overlap_company(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).select("ticker").intersect(_filings(spark, d).select("ticker"))


def overlap_company_year(spark: SparkSession, d: str) -> DataFrame:
    filings = _filings(spark, d).where("year IS NOT NULL").groupBy("ticker", "year").agg(F.countDistinct("doc_name").alias("filings"))
    examples = _examples(spark, d).groupBy("ticker", "year", "bolum").agg(F.count(F.lit(1)).alias("examples"))
    return examples.join(filings, ["ticker", "year"]).select("ticker", "year", "bolum", "examples", "filings")


def _affected(spark: SparkSession, d: str) -> DataFrame:
    seen = _examples(spark, d).select("ticker", "year").distinct()
    asked = S.questions(spark, d).select("qid", F.col("doc").alias("doc_name")).where("doc_name IS NOT NULL")
    return asked.join(_filings(spark, d), "doc_name").join(seen, ["ticker", "year"], "left_semi").select("qid", "doc_name", "ticker", "year").distinct()


def affected_questions(spark: SparkSession, d: str) -> DataFrame:
    return _affected(spark, d)


def exclusion_list(spark: SparkSession, d: str) -> DataFrame:
    """Training examples of the same company and year as an affected question's filing."""
    return _examples(spark, d).join(_affected(spark, d).select("ticker", "year"), ["ticker", "year"], "left_semi").select("id", "ticker", "year")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform("tablo", lambda row: F.concat_ws(" ", row))
    text = F.concat_ws(" ", "pre_text", cells, "post_text")
    examples = table(spark, d, "finqa", "id", "pre_text", "tablo", "post_text").select("id", text.alias("text")).groupBy("id").agg(F.max("text").alias("text"))
    return audit.containment(examples, table(spark, d, "kilitli_kanit", F.col("fb_soru").alias("item"), F.col("metin").alias("text")))


def contain_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("containment", F.round("containment", 6))


def contain_best(spark: SparkSession, d: str) -> DataFrame:
    return audit.best_containment(_pairs(spark, d)).withColumn("containment", F.round("containment", 6))


def contain_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = audit.best_containment(_pairs(spark, d))
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("containment") >= t / 10, 1)).alias(f"from_{t}_tenths") for t in (1, 3, 5, 8)])


def report_check(spark: SparkSession, d: str) -> DataFrame:
    """The old leak report against its sources: rows, repeats, unknown examples and items, shares above one."""
    r = table(spark, d, "sizinti_metin_raporu", "fb_soru", "finqa_id", "kapsama")
    known = table(spark, d, "finqa", F.col("id").alias("finqa_id")).distinct().withColumn("e", F.lit(1))
    items = table(spark, d, "kilitli_kanit", "fb_soru").distinct().withColumn("i", F.lit(1))
    j = r.join(known, "finqa_id", "left").join(items, "fb_soru", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fb_soru", "finqa_id").alias("pairs"), F.count(F.when(F.col("finqa_id").isNotNull() & F.col("e").isNull(), 1)).alias("unknown_example"),
        F.count(F.when(F.col("fb_soru").isNotNull() & F.col("i").isNull(), 1)).alias("unknown_item"), F.count(F.when(F.col("kapsama") > 1, 1)).alias("in_percent"),
    )


#: Random splits that are tried.
SEEDS = 10_000


def split_search(spark: SparkSession, d: str) -> DataFrame:
    company = S.company(F.col("doc"), F.col("qid"))
    counts = S.questions(spark, d).select(company.alias("grp"), F.coalesce("question_type", F.lit("-")).alias("kind")).groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return audit.split_search(counts, total // 3, SEEDS)


def streamed_requests(spark: SparkSession, d: str) -> DataFrame:
    return log.first_requests(spark, f"{d}/cevaplar.parquet").groupBy("model").agg(F.count(F.lit(1)).alias("requests"))


QUERIES = {
    f.__name__: f
    for f in (overlap_company, overlap_company_year, affected_questions, exclusion_list, contain_pairs, contain_best, contain_histogram, report_check, split_search, streamed_requests)
}

_EXAMPLES = r"""example AS (SELECT DISTINCT id, regexp_extract(id, '^([^/]+)/(\d{4})/page_\d+\.pdf-\d+$', 1) AS ticker, regexp_extract(id, '^([^/]+)/(\d{4})/page_\d+\.pdf-\d+$', 2)::INT AS year, bolum
  FROM finqa WHERE regexp_matches(id, '^[^/]+/\d{4}/page_\d+\.pdf-\d+$')), filing AS (SELECT DISTINCT doc_name, ticker, doc_period AS year FROM belgeler WHERE ticker IS NOT NULL)"""
_AFFECTED = f"""{S.QUESTIONS}, {_EXAMPLES}, affected AS (SELECT DISTINCT qid, doc_name, f.ticker, f.year FROM q JOIN filing f ON f.doc_name = q.doc SEMI JOIN example e ON e.ticker = f.ticker AND e.year = f.year)"""
_PAIRS = f"""ex AS (SELECT id, max(concat_ws(' ', array_to_string(pre_text, ' '), array_to_string(list_transform(tablo, lambda r: array_to_string(r, ' ')), ' '), array_to_string(post_text, ' '))) AS text FROM finqa GROUP BY id),
  et AS (SELECT id, {S.TOKENS.format('text')} AS w FROM ex), eg AS (SELECT id, list_distinct({S.sql_ngrams('w', 8)}) AS g FROM et), el AS (SELECT id, len(g) AS size, unnest(g) AS gram FROM eg),
  it AS (SELECT fb_soru AS item, {S.TOKENS.format('metin')} AS w FROM kilitli_kanit WHERE metin IS NOT NULL), il AS (SELECT item, unnest(list_distinct({S.sql_ngrams('w', 8)})) AS gram FROM it),
  pair AS (SELECT id, item, count(*) AS shared, any_value(size) AS size, count(*) / any_value(size) AS containment FROM el JOIN il USING (gram) GROUP BY id, item),
  top AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY item ORDER BY containment DESC, id) = 1)"""
SQL = {
    "overlap_company": f"WITH {_EXAMPLES} SELECT ticker FROM example INTERSECT SELECT ticker FROM filing",
    "overlap_company_year": f"""WITH {_EXAMPLES}, f AS (SELECT ticker, year, count(DISTINCT doc_name) AS filings FROM filing WHERE year IS NOT NULL GROUP BY ALL)
        SELECT ticker, year, bolum, count(*) AS examples, any_value(filings) AS filings FROM example JOIN f USING (ticker, year) GROUP BY ticker, year, bolum""",
    "affected_questions": f"WITH {_AFFECTED} SELECT * FROM affected",
    "exclusion_list": f"WITH {_AFFECTED} SELECT id, ticker, year FROM example SEMI JOIN affected a ON a.ticker = example.ticker AND a.year = example.year",
    "contain_pairs": f"WITH {_PAIRS} SELECT id, item, shared, size, round(containment, 6) AS containment FROM pair",
    "contain_best": f"WITH {_PAIRS} SELECT id, item, shared, size, round(containment, 6) AS containment FROM top",
    "contain_histogram": f"WITH {_PAIRS} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE containment >= {t} / 10) AS from_{t}_tenths" for t in (1, 3, 5, 8)) + " FROM top",
    "report_check": """SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT fb_soru, finqa_id FROM sizinti_metin_raporu WHERE fb_soru IS NOT NULL AND finqa_id IS NOT NULL)) AS pairs,
        count(*) FILTER (WHERE finqa_id IS NOT NULL AND finqa_id NOT IN (SELECT id FROM finqa WHERE id IS NOT NULL)) AS unknown_example,
        count(*) FILTER (WHERE fb_soru IS NOT NULL AND fb_soru NOT IN (SELECT fb_soru FROM kilitli_kanit)) AS unknown_item, count(*) FILTER (WHERE kapsama > 1) AS in_percent FROM sizinti_metin_raporu""",
    "split_search": f"""WITH {S.QUESTIONS}, c AS (SELECT upper(split_part(coalesce(doc, qid), '_', 1)) AS grp, coalesce(question_type, '-') AS kind, count(*) AS n FROM q GROUP BY ALL),
        t AS (SELECT sum(n)::BIGINT AS everything, floor(sum(n) / 3)::BIGINT AS target FROM c), g AS (SELECT grp, sum(n)::BIGINT AS n FROM c GROUP BY grp),
        s AS (SELECT seed, grp, n, coalesce(sum(n) OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', 's', seed, grp)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g, unnest(range(0, 10000)) AS u(seed)),
        k AS (SELECT s.* FROM s, t WHERE before < target), kk AS (SELECT seed, kind, sum(c.n) AS k FROM k JOIN c USING (grp) GROUP BY ALL), kt AS (SELECT kind, sum(n) AS total FROM c GROUP BY kind),
        o AS (SELECT x.seed, sum(abs(coalesce(kk.k, 0) * everything - total * target)) AS off FROM (SELECT seed, kind, total FROM kt, unnest(range(0, 10000)) AS u(seed)) x LEFT JOIN kk ON kk.seed = x.seed AND kk.kind = x.kind, t GROUP BY x.seed),
        h AS (SELECT seed, sum(n)::BIGINT AS members, count(*) AS groups FROM k GROUP BY seed)
        SELECT seed::INT AS seed, groups, members, (abs(members - target) * everything + off)::BIGINT AS score FROM h JOIN o USING (seed), t ORDER BY score, seed LIMIT 1""",
    "streamed_requests": "SELECT model, count(*) AS requests FROM (SELECT DISTINCT id, istek_sha256, model FROM cevaplar WHERE hata IS NULL) GROUP BY model",
}
