from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspan.operators import quantities as q

CASES = [
    ("$1,234.5 million", "", "en", "usd", 1234500000),
    ("US$ 3.1mm", "", "en", "usd", 3100000),
    ("$163.4", "capital expenditure in millions of X?", "en", "usd", 163400000),
    ("$2,000", "What is the capital expenditure of X?", "en", "usd", 2000),
    ("163.4", "capital expenditure in USD millions of X?", "en", "usd", 163400000),
    ("minus $4.5 billion", "", "en", "usd", -4500000000),
    ("−23.2", "net revenue in millions of X?", "en", "usd", -23200000),
    ("2.063,1 milyon ABD doları", "", "tr", "usd", 2063100000),
    ("0,3151 mil millones de USD", "", "es", "usd", 315100000),
    ("4 041,5 millions de dollars", "", "fr", "usd", 4041500000),
    ("3,4 Mio. US-Dollar", "", "de", "usd", 3400000),
    ("12.5%", "", "en", "oran", 1250),
    ("yüzde 46,44", "", "tr", "oran", 4644),
    ("a ratio of 0.3641", "", "en", "oran", 3641),
    ("331.5 per mille", "", "en", "oran", 3315),
    ("4,662 basis points", "", "en", "oran", 4662),
    ("0.5", "operating margin as a fraction of one of X?", "en", "oran", 5000),
    ("0.81m shares.", "", "en", "adet", 810000),
    ("6160", "Yanıtı bin pay olarak veriniz.", "en", "adet", 6160000),
    ("410 Tausend Aktien", "", "de", "adet", 410000),
    ("50,600 megawatt hours for FY2014", "", "en", "kwh", 50600000),
    ("0,0002TWh", "", "tr", "kwh", 200000),
    ("4.5 thousand MWh", "", "en", "kwh", 4500000),
    ("6 weeks", "", "en", "gun", 42),
    ("576 saat", "", "tr", "gun", 24),
    ("The value is 101 days.", "", "en", "gun", 101),
    ("Yes, it improved in 2019.", "", "en", None, None),
    ("What is the FY2019 capital expenditure in millions of X?", "", "en", None, None),
    ("2019", "", "en", None, None),
    ("", "in millions", "en", None, None),
    (None, "in millions", "en", None, None),
]


def test_grammar(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, q string, lang string")
    found = {r["i"]: r["x"] for r in rows.select("i", q.quantity(F.col("t"), q.wanted_unit(F.col("q")), F.col("lang")).alias("x")).collect()}
    for i, (text, question, _, measure, value) in enumerate(CASES):
        got = (found[i]["olcu"], found[i]["deger"]) if found[i] else (None, None)
        assert got == (measure, value), (text, question, got)


@pytest.mark.parametrize(
    ("answer", "statement"),
    [("x\nFinal answer: 5 days\nSources: none", "5 days"), ("Final answer: 1\nFINAL ANSWER - 2 weeks", "2 weeks"), ("Final answer:\n**3 days**", "3 days"), ("5 days", None)],
)
def test_final_statement(spark, answer, statement):
    got = spark.createDataFrame([(answer,)], "a string").select(q.final_statement(F.col("a"))).first()[0]
    assert (got.strip(" \n*") if got else got) == statement


def test_tables_with_nulls_repeats_extra_columns_and_no_rows(spark):
    questions = spark.createDataFrame(
        [(1, "a", "How long in days?", "5 days", "x"), (2, "a", "How long in days?", "7", "x"), (3, None, None, None, "x"), (4, "b", "q", "", "x")],
        "kayit_no bigint, financebench_id string, question string, answer string, olcu string",
    )
    answers = spark.createDataFrame([(1, "a", "Final answer: 9", "y"), (2, None, "Final answer: 3 weeks", "y"), (3, "a", None, "y"), (4, "zz", "", "y"), (5, "a", "x" * 200_000, "y")], "kayit_no bigint, id string, yanit string, q string")
    got = sorted(map(tuple, q.stated_quantities(questions, answers).collect()))
    assert got == [("cevaplar", 1, "gun", 9), ("cevaplar", 2, "gun", 21), ("sorular", 1, "gun", 5), ("sorular", 2, "gun", 7)]
    assert q.stated_quantities(questions.limit(0), answers.limit(0)).count() == 0
