"""Answers graded against gold answers by deterministic rules, grades merged, and citations against evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T

EXPECTED = {"thousands": 1e3, "millions": 1e6, "billions": 1e9}
#: The relative tolerance of numbers, and the absolute one where gold is 0.
TOLERANCE, TOLERANCE_AT_ZERO = 0.01, 0.005


def bare_year(n: Column) -> Column:
    """A whole number from 1900 to 2100 without percent sign and scale word."""
    low, high = T.BARE_YEARS
    return (n["decimals"] == 0) & ~n["percent"] & (n["scale"] == 1) & (n["value"] >= low) & (n["value"] <= high)


def in_unit(n: Column, expected: Column) -> Column:
    """The value in the scale a question asks for; a number without a scale word is in it already."""
    return F.when(expected.isNotNull() & (n["scale"] != 1), n["value"] * n["scale"] / expected).otherwise(n["value"])


def rounded(x: Column, decimals: Column) -> Column:
    """Half up on the written digits of a number, at so many decimals; beyond twelve nothing is rounded."""
    at = F.when(decimals == 0, F.round(x, 0))
    for k in range(1, 13):
        at = at.when(decimals == k, F.round(x, k))
    return at.otherwise(x)


def number_grade(gold: Column, answer: Column, question: Column) -> Column:
    """struct(value, precise, tolerant) of the number in ``answer`` that is most like the first number of ``gold``.

    Candidates lose bare years unless gold is one (or nothing else is left). The candidate that agrees with gold in most
    of dollar sign, percent sign and having decimals is graded, the first of equals: ``precise`` if it rounds to gold at
    gold's decimals, ``tolerant`` within one percent (0.005 if gold is 0). Null where either holds no number.
    """
    unit = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])

    def best(b: Column) -> Column:
        g = F.get(b["gold"], F.lit(0))
        kept = F.filter(b["found"], lambda n: bare_year(g) | ~bare_year(n))
        like = lambda n: sum(((n[k] == g[k]).cast("int") for k in ("dollar", "percent")), ((n["decimals"] > 0) == (g["decimals"] > 0)).cast("int"))
        candidates = F.transform(F.when(F.size(kept) > 0, kept).otherwise(b["found"]), lambda n, i: F.struct(like(n).alias("like"), (-i).alias("place"), in_unit(n, b["unit"]).alias("value")))
        return F.struct(F.array_max(candidates)["value"].alias("value"), g["value"].alias("gold"), g["decimals"].alias("decimals"))

    def judge(x: Column) -> Column:
        near = F.when(x["gold"] == 0, F.abs(x["value"]) <= TOLERANCE_AT_ZERO).otherwise(F.abs(x["value"] - x["gold"]) <= TOLERANCE * F.abs(x["gold"]))
        return F.struct(x["value"].alias("value"), (rounded(x["value"], x["decimals"]) == rounded(x["gold"], x["decimals"])).alias("precise"), near.alias("tolerant"))

    both = F.struct(T.numbers(gold).alias("gold"), T.numbers(answer).alias("found"), unit[T.expected_unit(question)].alias("unit"))
    return T.let(both, lambda b: F.when((F.size(b["gold"]) > 0) & (F.size(b["found"]) > 0), T.let(best(b), judge)))


def key_numbers(gold: Column) -> Column:
    """array<struct<value, decimals, percent, scale, dollar>> of the numbers of a gold text that count: a whole number without
    percent sign and scale word only from 100 on and if it could not be a year."""
    low, high = T.BARE_YEARS
    size = lambda n: F.abs(n["value"])
    plain = lambda n: (n["decimals"] == 0) & ~n["percent"] & (n["scale"] == 1)
    return F.filter(T.numbers(gold), lambda n: ~(plain(n) & ((size(n) < 100) | ((size(n) >= low) & (size(n) <= high)))))


def key_number_grade(gold: Column, answer: Column) -> Column:
    """struct(share, everything, n) of gold's key numbers that the answer has outside its sources: equal at gold's own
    decimals and in gold's scale, or within one percent. Null if gold has none; an answer that is null has none."""
    have = F.transform(T.numbers(T.without_sources(F.coalesce(answer, F.lit("")))), lambda n: n["value"] * n["scale"])

    def met(found: Column, keys: Column) -> Column:
        equal = lambda k, h: rounded(h / k["scale"], k["decimals"]) == rounded(k["value"], k["decimals"])
        near = lambda k, h: (k["value"] != 0) & (F.abs(h - k["value"] * k["scale"]) <= TOLERANCE * F.abs(k["value"] * k["scale"]))
        return F.size(F.filter(keys, lambda k: F.exists(found, lambda h: equal(k, h) | near(k, h))))

    def graded(x: Column) -> Column:
        n = F.size(x["keys"])
        return F.when(n > 0, T.let(met(x["have"], x["keys"]), lambda m: F.struct((m / n).alias("share"), (m == n).alias("everything"), n.alias("n"))))

    return T.let(F.struct(have.alias("have"), key_numbers(gold).alias("keys")), graded)


def grade(gold: Column, answer: Column, question: Column) -> Column:
    """struct(kind, correct, tolerant, share) of an answer by the kind of its gold: a number is correct if precise, a verdict if
    equal, a text with key numbers if the answer has all of them. ``correct`` is null where no rule can tell (no key
    numbers, no numbers and no verdict); an answer that is null or states nothing is wrong where one can."""
    final = T.final_answer(F.coalesce(answer, F.lit("")))
    wrong = lambda c: F.coalesce(c, F.lit(False)).cast("int")

    def by_kind(kind: Column) -> Column:
        number = F.when(kind == "number", number_grade(gold, final, question))
        keys = F.when(kind == "key_number", key_number_grade(gold, answer))
        said = F.when(kind == "verdict", wrong(T.verdict(final) == T.verdict(F.trim(gold))))
        return T.let(F.struct(number.alias("number"), keys.alias("keys")), lambda g: F.struct(
            kind.alias("kind"), F.when(kind == "number", wrong(g["number"]["precise"])).when(kind == "verdict", said).when(g["keys"].isNotNull(), g["keys"]["everything"].cast("int")).alias("correct"),
            F.when(kind == "number", wrong(g["number"]["tolerant"])).alias("tolerant"), g["keys"]["share"].alias("share")))

    return T.let(T.gold_type(gold), by_kind)


def merged_grades(automatic: DataFrame, others: list[DataFrame], keys: list[str], lenient: bool = False) -> DataFrame:
    """``automatic`` (keys, correct) with ``correct`` filled, where no rule could tell, from the first of ``others`` (keys, grade) that
    knows the answer: ``correct`` counts, ``partial`` only where ``lenient``. Repeated grades of one answer must agree; the least
    counts if they don't. What nobody graded stays null."""
    counted = lambda g: F.when(g == "correct", 1).when(g == "partial", int(lenient)).when(g == "wrong", 0)
    found = automatic
    for i, other in enumerate(others):
        found = found.join(other.groupBy(*keys).agg(F.min(counted(F.col("grade"))).alias(f"__other{i}")), keys, "left")
    filled = F.coalesce("correct", *[F.col(f"__other{i}") for i in range(len(others))])
    return found.withColumn("correct", filled).drop(*[f"__other{i}" for i in range(len(others))])


def checked_grades(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, keys) of grades that don't fit: ``missing`` of an expected answer, ``unknown`` for none, ``invalid`` by their word.
    A merge should go on only where this is empty."""
    rows = lambda df, why: df.select(F.lit(why).alias("problem"), *keys).distinct()
    parts = [rows(expected.join(given, keys, "left_anti"), "missing"), rows(given.join(expected, keys, "left_anti"), "unknown")]
    return reduce(DataFrame.unionByName, [*parts, rows(given.where("grade IS NULL OR grade NOT IN ('correct', 'partial', 'wrong')"), "invalid")])


def citation_scores(cited: DataFrame, gold: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(record, qid, n_cited, n_right[, n_seen]): distinct cited pages of each record, those among its question's evidence pages and
    those among the pages of its context. ``cited`` is (record, qid, pages array<struct<doc, page>>), the others (qid, doc, page)."""
    spread = cited.select("record", "qid", F.explode_outer("pages").alias("p")).select("record", "qid", F.col("p.doc").alias("doc"), F.col("p.page").alias("page"))
    right = gold.select("qid", "doc", "page").distinct().withColumn("right", F.lit(1))
    found, counts = spread.join(right, ["qid", "doc", "page"], "left"), [F.count("doc").alias("n_cited"), F.count("right").alias("n_right")]
    if context is not None:
        found = found.join(context.select("qid", "doc", "page").distinct().withColumn("seen", F.lit(1)), ["qid", "doc", "page"], "left")
        counts.append(F.count("seen").alias("n_seen"))
    return found.groupBy("record", "qid").agg(*counts)
