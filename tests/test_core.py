from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import ann, audit, chunking, dense, grading, lexical, metrics, ranking, requests, routing, store
from quillspan.plans import answers, grades


def every(spark, column, rows, kinds="a string"):
    """``column`` of every row, in one job."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def one(spark, column, *values, kinds="a string"):
    return spark.createDataFrame([tuple(values)], kinds).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    cases = [
        ("0.96x", [0.96]), ("($1.8 bn)", [1.8]), (" fell -14.76%", [-14.76]), ("2018-2019", [2018, 2019]), ("FY2018 Q2", []), ("Form 10-K and 8-K, 10-Q", []),
        ("3M reported $5M and 1.5m", [5, 1.5]), ("", []), (None, []), ("1,577.00 and 12", [1577, 12]), ("1,23 and 12345,678,901 and 0,3328", [1, 23, 12345, 678901, 0, 3328]),
        ("5apples, 7 -3, US$5 and -$ 4", [7, -3, 5, -4]), ("done:\n-100% of it", [100]), ("10 k-K, 5%, − 2 x", [5, -2]),
    ]
    got = every(spark, T.numbers(F.col("a")), [t for t, _ in cases])
    assert [(t, [n["value"] for n in g]) for (t, _), g in zip(cases, got)] == cases


@pytest.mark.parametrize(("n", "overlap", "starts"), [(200, 0, [0]), (201, 0, [0, 200]), (200, 50, [0]), (201, 50, [0, 150]), (351, 50, [0, 150, 300]), (0, 0, [])])
def test_windows(spark, n, overlap, starts):
    pages = spark.createDataFrame([(1, " ".join(str(i) for i in range(n))), (2, None)], "key int, text string")
    got = [r["body"].split()[0] for r in chunking.chunked(pages, "key", "text", 200, overlap).orderBy("k").collect()]
    assert [int(x) for x in got] == starts


@pytest.mark.parametrize(("counts", "taken"), [([400] * 4, [400, 400, 200]), ([3, 2], [3, 2]), ([1000, 5], [1000]), ([600, 300, 10, 300], [600, 300, 10, 90])])
def test_context_cut(spark, counts, taken):
    rows = spark.createDataFrame([("q", i + 1, n) for i, n in enumerate(counts)], "qid string, rank int, n_words int")
    assert [r["taken"] for r in metrics.cut_to_budget(rows).orderBy("rank").collect()] == taken


def test_fusion_by_hand(spark):
    a, b = (spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(x)], "qid string, chunk_id string, rank int") for x in ("xyz", "yxw"))
    assert [r["chunk_id"] for r in ranking.fused([a, b], "qid", "chunk_id").orderBy("rank").collect()] == ["x", "y", "w", "z"]
    assert [r["chunk_id"] for r in ranking.fused([a], "qid", "chunk_id").orderBy("rank").collect()] == ["x", "y", "z"]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).round(3)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [(60, None, 1)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    queries = corpus.where("vec_id < 7").withColumnRenamed("vec_id", "query")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for same in (None, "label"):
        got = {(r["query"], r["rank"]): r["vec_id"] for r in dense.search(queries, corpus, 5, same, block=3, piece=20).collect()}
        assert got == {(r["query"], r["rank"]): r["vec_id"] for r in dense.search(queries, corpus, 5, same).collect()}
        for q in range(7):
            score = unit @ unit[q]
            order = [i for i in sorted(range(60), key=lambda i: (-round(score[i], 9), i)) if same is None or i % 3 == q % 3][:5]
            assert [got[q, k + 1] for k in range(5)] == order


def test_bootstrap_of_equal_units_is_a_point(spark):
    units = spark.createDataFrame([(f"u{i}", 1, 2) for i in range(9)], "unit string, num int, den int")
    reps = metrics.bootstrap(units, ["num", "den"], 40).withColumn("v", F.col("num") / F.col("den"))
    assert tuple(metrics.interval(reps, "v", 40).first()) == (0.5, 0.5)
    assert reps.agg(F.sum("den")).first()[0] == 40 * 9 * 2


def test_number_grade(spark):
    cases = [  # gold, answer, question: precise and tolerant
        ("$1577.00", "$1.577 billion", "in USD millions", True, True), ("$1577.00", "$1,580", "in USD millions", False, True), ("$1577.00", "$1,700", "in USD millions", False, False), ("12.5%", "13.2% in 2019", "", False, False),
        ("1.01", "1.005", "", True, True), ("2.68", "2.675", "", True, True), ("2.67", "2.675", "", False, True), ("0.13", "0.125", "", True, False), ("2022", "It was 2022.", "", True, True), ("12.3%", "12.4%", "", False, True), ("0", "0.006", "", True, False),
        ("$1577.00", "Per page 59 of the 10-K for FY2018, 3M's capital expenditure for 2018 was $1,577 million.", "in USD millions", True, True), ("Yes", "12", "", None, None), ("12", "none", "", None, None), (None, "1", "", None, None),
    ]
    got = every(spark, grading.number_grade(F.col("g"), F.col("a"), F.col("q")), [c[:3] for c in cases], "g string, a string, q string")
    assert [(*c[:3], g and g["precise"], g and g["tolerant"]) for c, g in zip(cases, got)] == cases


def test_key_numbers(spark):
    assert [n["value"] for n in one(spark, grading.key_numbers(F.col("a")), "It rose 1.7% with 3 plants in 2022")] == [1.7]
    assert math.isclose(one(spark, grading.key_number_grade(F.col("a"), F.col("b"))["share"], "1.7% and $5 million", "about 1.7%", kinds="a string, b string"), 0.5)


def test_key_number_grade(spark):
    cases = [
        ("1.7% and $5 million", "1.7%\nSources: A_2019, page 7\nB_2, 5,000,000", 0.5, False),  # a number among the sources is not found
        ("It fell to 0.2%", "Sources: A, 7\nFinal answer: 0.24%", 1.0, True),  # equal at gold's decimals, beyond one percent
        ("0.0% and 250", "0.04 and 252", 1.0, True), ("0.0% and 250", "0.06 and 252", 0.5, False), ("$5 and 2022", "5", None, None), ("1.7%", None, 0.0, False), (None, "1.7%", None, None),
    ]
    got = every(spark, grading.key_number_grade(F.col("g"), F.col("a")), [c[:2] for c in cases], "g string, a string")
    assert [(*c[:2], g and g["share"], g and g["everything"]) for c, g in zip(cases, got)] == cases


def test_key_number_gold_is_the_answer_and_every_evidence(spark, tmp_path):
    asked = [(1, "q1", "d", "x", "About 12.5% of sales", "t", [("d", 1, "It was 3.25%"), ("d", 2, "It was 12.5%")]), (2, "q2", "d", "x", "12.5%", "t", [("d", 1, "It was 7.75%")])]
    kinds = "kayit_no bigint, financebench_id string, doc_name string, question string, answer string, question_type string, evidence array<struct<doc_name: string, evidence_page_num: int, evidence_text: string>>"
    spark.createDataFrame(asked, kinds).write.parquet(f"{tmp_path}/sorular.parquet")
    given = [(1, "q1", "k", "m", "v", None, "12.5%", None), (2, "q2", "k", "m", "v", None, "12.5%", None)]
    spark.createDataFrame(given, "kayit_no bigint, id string, kosul string, model string, prompt_surum string, tarih timestamp, yanit string, hata string").write.parquet(f"{tmp_path}/cevaplar.parquet")
    assert [tuple(r) for r in grades.key_number_grades(spark, str(tmp_path)).collect()] == [("m", "k", 1.0, 1.0, 1)]
    assert [tuple(r) for r in grades.key_number_evidence(spark, str(tmp_path)).collect()] == [("m", "k", 0.333333, 0.333333, 3)]


def test_verdict(spark):
    cases = [
        ("Yes, it rose.", "yes"), ("**No.**", "no"), ("Yes it is", "yes"), ("There is no question that it is", None), ("It is no longer so", None), ("Nothing", None), ("", None), (None, None),
        ("Based on FY2022 data, no, 3M is not capital-intensive.", "no"), ("a b c d e f g h i j k l no, it is not", None), ("The short answer is yes", "yes"),
    ]
    got = every(spark, T.verdict(F.col("a")), [t for t, _ in cases])
    assert [(t, g) for (t, _), g in zip(cases, got)] == cases


def test_citations_and_final_answer(spark):
    text = "x\n**Final answer:** 5\n**Sources:** A_2019_10K, p. 7; A_2019_10K, page 7; B_1, 9"
    assert [tuple(c) for c in one(spark, T.citations(F.col("a")), text)] == [("A_2019_10K", 7), ("B_1", 9)]
    assert one(spark, T.final_answer(F.col("a")), text) == "5"
    assert one(spark, T.citations(F.col("a")), "Sources: none") == [] and one(spark, T.citations(F.col("a")), None) is None


def test_sources_are_cut_from_the_answer(spark):
    cases = [
        ("Final answer: 5\nSources:\nDOC_2022_10K, page 7\nB.x_1, p 12", "5", [("DOC_2022_10K", 7), ("B.x_1", 12)]), ("Final answer: 5\nSources - X_1, sayfa 45", "5", [("X_1", 45)]),
        ("Sources: DOC_2022_10K, 59\nFinal answer: $1,577 million", "$1,577 million", [("DOC_2022_10K", 59)]), ("Final answer: 5\n**Sources:** [doc: A_8K_dated-2022-07-01, page: 2]", "5", [("A_8K_dated-2022-07-01", 2)]),
        ("Final answer: 1\nfinal answer - 2", "2", []), ("no mark", "no mark", []), ("", "", []), ("Sources: A_1, 99999999999", "", [("A_1", None)]),
    ]
    got = every(spark, F.struct(T.final_answer(F.col("a")).alias("f"), T.citations(F.col("a")).alias("c")), [c[0] for c in cases])
    assert [(c[0], g["f"], [tuple(p) for p in g["c"]]) for c, g in zip(cases, got)] == cases


def test_gold_type(spark):
    cases = [("$1577.00", "number"), ("(12.5%)", "number"), ("-5", "number"), ("106 million dollars", "key_number"), ("Yes. 5", "verdict"), ("No", "verdict"), ("Nothing", "free"), ("", "free"), (None, None)]
    got = every(spark, T.gold_type(F.col("a")), [t for t, _ in cases])
    assert [(t, g) for (t, _), g in zip(cases, got)] == cases


def test_expected_unit(spark):
    cases = [("in USD millions", "millions"), ("expressed in U.S. dollars billions", "billions"), ("in thousands of shares", "thousands"), ("It made millions. Say how much.", None), (None, None)]
    got = every(spark, T.expected_unit(F.col("a")), [t for t, _ in cases])
    assert [(t, g) for (t, _), g in zip(cases, got)] == cases


def test_grade(spark):
    cases = [
        ("0.96", "The quick ratio is 0.96x", 1), ("0.96", None, 0), ("No, it fell", "**Final answer:** **No**, it fell.\nSources: A_1, 41", 1), ("Yes", "Final answer: perhaps", 0), ("Up 100% in FY2022", "Final answer: Up 100%\nSources: A_1, 7", 1),
        ("Up 100% in FY2022", "Final answer: Up.\nSources: A_1, 100", 0), ("In 3 plants", "3 plants", None), ("Prices rose", "Prices rose", None), (None, "x", None),
    ]
    got = every(spark, grading.grade(F.col("g"), F.col("a"), F.lit("In USD millions?")), [c[:2] for c in cases], "g string, a string")
    assert [(*c[:2], g["correct"]) for c, g in zip(cases, got)] == cases


def test_grades_merge_in_order_and_are_checked(spark):
    automatic = spark.createDataFrame([(1, 1), (2, None), (3, None), (4, None), (5, None)], "id int, correct int")
    second, first = (spark.createDataFrame(rows, "id int, grade string") for rows in ([(2, "partial"), (1, "wrong")], [(2, "wrong"), (3, "correct"), (5, "odd")]))
    for lenient, want in ((False, {1: 1, 2: 0, 3: 1, 4: None, 5: None}), (True, {1: 1, 2: 1, 3: 1, 4: None, 5: None})):
        assert {r["id"]: r["correct"] for r in grading.merged_grades(automatic, [second, first], ["id"], lenient).collect()} == want
    problems = grading.checked_grades(automatic.where("id < 4").select("id"), first, ["id"]).collect()
    assert sorted(map(tuple, problems)) == [("invalid", 5), ("missing", 1), ("unknown", 5)]
    assert [one(spark, T.judge_label(F.col("a")), t) for t in ("**Grade:** Correct", "grade: *partial*", "good", None)] == ["correct", "partial", None, None]


def test_fiscal_years(spark):
    years = lambda t: one(spark, T.fiscal_years(F.col("a")), t)
    assert years("FY19 and fiscal year 2021, Q2 of 2018, 2015.") == [2015, 2018, 2019, 2021]
    assert years("$2,019 or 2019.5 or 12019") == [] and years(None) == [] and years("") == []
    assert years("Q22023 over Q2 of FY2022 and fy '18") == [2018, 2022, 2023] and years("from 2015 to 2017, FY 2031 and FY09") == [2015, 2017]


def test_routing(spark):
    catalog = spark.createDataFrame([("A_2018", "Foo Bar Inc.", 2018), ("A_2019", "Foo Bar", 2019), ("A_2021", "FooBar Corp", 2021), ("B", "Baz Corp.", 2019), ("C", None, 2019)], "doc_name string, company string, doc_period int")
    asked = spark.createDataFrame([(1, "What did Foo Bar earn in 2018?"), (2, "foobar margin"), (3, "nothing here"), (4, "Baz's result in 2012"), (5, None)], "qid int, question string")
    got = {}
    for r in routing.route(asked, catalog).collect():
        got.setdefault(r["qid"], set()).add((r["doc_name"], r["rule"]))
    assert got == {1: {("A_2018", "year"), ("A_2019", "year")}, 2: {(d, "company") for d in ("A_2018", "A_2019", "A_2021")}, 4: {("B", "company")}}


def test_mentions(spark):
    names = ["Johnson & Johnson", "American Express", "McDonalds", "Best Buy Co.", "The Bank of New York Mellon Trust Company", "AMD", "PG&E Corporation", "Inc.", None]
    catalog = spark.createDataFrame([(f"d{i}", n, 2019) for i, n in enumerate(names)], "doc_name string, company string, doc_period int")
    cases = {
        "Which segment of J&J was cut?": ["johnson johnson"], "JnJ margin": ["johnson johnson"], "What is Amex's dividend?": ["american express"], "What did McDonald's report?": ["mcdonalds"], "Best Buys sales": ["best buy"], "BestBuy": ["best buy"],
        "Did The Bank of New York Mellon Trust grow?": ["the bank of new york mellon trust"], "the average demand": [], "PG&E and AMD": ["amd", "pg e"], "": [],
    }
    asked = spark.createDataFrame([(q, q) for q in cases] + [("null", None)], "qid string, question string")
    got = {q: [] for q in cases}
    for r in routing.mentions(asked, catalog).collect():
        got[r["qid"]].append(r["company"])
    assert {q: sorted(c) for q, c in got.items()} == cases
    assert routing.mentions(asked.limit(0), catalog).count() == 0 and routing.mentions(asked, catalog.limit(0)).count() == 0


def test_routed_ranking(spark):
    scored = spark.createDataFrame([("q", "a", "d1", 3.0), ("q", "b", "d2", 2.0), ("q", "c", "d2", 2.0), ("r", "a", "d1", 1.0)], "qid string, chunk_id string, doc string, score double")
    routed = spark.createDataFrame([("q", "d2"), ("q", "d9")], "qid string, doc_name string")
    assert sorted((r["qid"], r["rank"], r["chunk_id"]) for r in routing.routed_ranking(scored, routed, 5).collect()) == [("q", 1, "b"), ("q", 2, "c"), ("r", 1, "a")]


def test_letters_go_on_after_z(spark, tmp_path):
    rows = [(i, "q", f"k{i % 6}", f"m{i}", "v2", None, "x", None) for i in range(60)]
    spark.createDataFrame(rows, "kayit_no bigint, id string, kosul string, model string, prompt_surum string, tarih timestamp, yanit string, hata string").write.parquet(f"{tmp_path}/cevaplar.parquet")
    letters = [r["letter"] for r in answers.blind_assignment(spark, str(tmp_path)).collect()]
    assert len(set(letters)) == 60 and {"A", "Z", "A2", "Z2", "H3"} <= set(letters)


def test_requests_keep_braces_of_the_question(spark):
    asked = spark.createDataFrame([("q", "What was {FY2022}? Use {CONTEXT} words."), ("n", None)], "qid string, question string")
    contexts = spark.createDataFrame([("q", "K1", "[doc: X, page: 1]\ntext", 1, [("X", 1)])], "qid string, kosul string, context string, n_words int, pages array<struct<doc: string, page: int>>")
    got = {r["kosul"]: r["text"] for r in requests.requests(asked, contexts).collect()}
    assert set(got) == {"K0", "K1"} and all(t.count("What was {FY2022}? Use {CONTEXT} words.") == 1 for t in got.values())
    assert "[doc: X, page: 1]" in got["K1"] and "[doc:" not in got["K0"] and "Sources:" not in got["K0"]
    with pytest.raises(ValueError, match="locked"):
        requests.refuse_locked(asked, asked.limit(1))
    assert requests.refuse_locked(asked, asked.limit(1), allowed=True) is asked and requests.refuse_locked(asked, asked.limit(0)) is asked


def test_store_is_built_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    assert [store.ensured(r, f"{tmp_path}/s", "k") for r in (rows, rows, rows.limit(1), rows)] == [True, False, True, True]


def test_cells_find_near_vectors_with_few_comparisons(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(20, 16))
    vectors = heads[np.arange(1000) % 20] + 0.15 * rng.normal(size=(1000, 16))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 16)], "vec_id bigint, embedding array<double>")
    queries = corpus.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    centres = ann.centroids(corpus)
    index = ann.indexed(corpus, centres)
    hit = ann.recall(dense.search(queries, corpus, 10), ann.search(queries, index, centres, 10, 4, block=7, piece=20), 10).agg(F.sum("shared"), F.sum("size")).first()
    assert hit[0] / hit[1] >= 0.95 and ann.compared(queries, index, centres, 4).first()[0] <= 0.2 * 20 * 1000
    nothing = corpus.limit(0)
    assert ann.search(nothing.withColumnRenamed("vec_id", "query"), index, centres, 10, 4).count() == 0 and dense.search(queries, nothing, 3).count() == 0
    assert ann.indexed(nothing, ann.centroids(nothing)).count() == 0


def test_pruned_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = 1 / np.arange(1, 41)
    texts = [(f"c{i}", " ".join(rng.choice(vocabulary, rng.integers(1, 30), p=weights / weights.sum()))) for i in range(400)] + [("empty", ""), ("null", None)]
    asked = [(i, " ".join(rng.choice(vocabulary, 6, p=weights / weights.sum()))) for i in range(12)] + [(98, "unknown words"), (99, None)]
    split = {c: t.split() for c, t in texts if t}
    n, average = len(split), sum(map(len, split.values())) / len(split)
    df = {w: sum(w in t for t in split.values()) for w in vocabulary}
    want = []
    for q, question in asked:
        score = {}
        for c, t in split.items():
            x = 0.0
            for w in (question or "").split():
                if w in t and (idf := max(0.0, math.log((n - df[w] + 0.5) / (df[w] + 0.5)))) > 0:
                    x += idf * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average))
            if x > 0:
                score[c] = round(x, 6)
        want += [(q, c, k + 1) for k, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:10])]
    got = lexical.bm25(spark.createDataFrame(asked, "query int, question string"), spark.createDataFrame(texts, "chunk_id string, text string"))
    assert sorted((r["query"], r["chunk_id"], r["rank"]) for r in got.collect()) == sorted(want)


def rows_shuffled(spark) -> int:
    """Rows that all stages so far have written for a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, empty)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_search_over_all_texts_sends_few_rows(spark):
    """Terms that nearly half of the texts hold: neither a row a term of a text nor a row a query and text is shuffled."""
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(8)
    texts = spark.createDataFrame([(f"c{i}", " ".join(rng.choice(words, 16, replace=False))) for i in range(1500)], "chunk_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 6, replace=False))) for i in range(20)], "query int, question string")
    before = rows_shuffled(spark)
    assert len(lexical.bm25(asked, texts).collect()) == 200
    assert rows_shuffled(spark) - before < 2 * 1500  # was 37,798 when postings and hits were shuffled


def test_search_in_pieces_and_blocks(spark):
    """Equal texts and equal questions, words twice in a question, several pieces and blocks: SQL's order, scores and ties."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    texts = [(f"c{i}", " ".join(rng.choice(words, rng.integers(1, 6)))) for i in rng.permutation(300)] + [("Ü", "W1-w2, W1"), ("none", "...")]
    asked = [(i, " ".join(rng.choice(words, 3))) for i in range(15)] + [(40, "w3 w1"), (41, "W1 w3?"), (42, "w1 w1 w3 other"), (43, "other")]
    split = {c: re.findall("[a-z0-9]+", t.lower()) for c, t in texts}
    n, average = 301, sum(map(len, split.values())) / 301
    idf = {w: math.log((n - df + 0.5) / (df + 0.5)) for w in words for df in [sum(w in t for t in split.values())] if df < n / 2}
    want = {}
    for q, question in asked:
        terms = [w for w in re.findall("[a-z0-9]+", question.lower()) if w in idf]
        score = {c: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in terms), 6) for c, t in split.items() if set(t) & set(terms)}
        want |= {(q, k + 1): (c, score[c]) for k, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:4])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = lexical.bm25(spark.createDataFrame(asked, "query int, question string"), spark.createDataFrame(texts, "chunk_id string, text string"), 4, piece=20, block=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r["query"], r["rank"]): (r["chunk_id"], pytest.approx(r["score"], abs=1e-9)) for r in got} == want
    nothing = spark.createDataFrame([], "chunk_id string, text string")
    assert lexical.bm25(spark.createDataFrame(asked, "query int, question string"), nothing).count() == 0


def test_containment_by_hand(spark):
    words = [f"w{i}" for i in range(20)]
    examples = spark.createDataFrame([("a", " ".join(words[:12])), ("b", "short"), ("c", None)], "id string, text string")
    items = spark.createDataFrame([("i", " ".join(words[2:20]))], "item string, text string")
    assert [tuple(r) for r in audit.containment(examples, items).collect()] == [("a", "i", 3, 5, 0.6)]
