"""Retrieval metrics from rankings and evidence, context windows, and resampled intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import ngrams, tokens
from quillspan.session import written


def first_hits(evidence: DataFrame, located: DataFrame) -> DataFrame:
    """(qid, ev, hit): the best rank of a chunk on the evidence's page; null if none. ``located`` is (qid, rank, doc,
    page) of the ranking; evidence rows that repeat a page all count."""
    pages = located.groupBy("qid", "doc", "page").agg(F.min("rank").alias("hit"))
    return evidence.select("qid", "ev", "doc", "page").join(pages, ["qid", "doc", "page"], "left").select("qid", "ev", "hit")


def recall(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """(metric, num, den): ratio of sums over evidence rows; the reciprocal rank is summed in millionths."""
    sums = [F.sum(F.when(F.col("hit") <= k, 1).otherwise(0)).alias(f"recall@{k}") for k in ks]
    reciprocal = F.sum(F.round(F.coalesce(1e6 / F.col("hit"), F.lit(0.0))).cast("bigint")).alias("mrr")
    row = hits.agg(*sums, reciprocal, F.count(F.lit(1)).alias("den"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("num"), "den") for c in [*(f"recall@{k}" for k in ks), "mrr"]])).alias("r")).select("r.*")


def words_before() -> Column:
    """Words of the better ranked chunks of the same question."""
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_words").over(before), F.lit(0)).cast("bigint")


def within_budget(ranked: DataFrame, budget: int = 1000) -> DataFrame:
    """Chunks that begin before the budget of words is used up; the last one is kept whole."""
    return ranked.withColumn("before", words_before()).where(F.col("before") < budget)


def cut_to_budget(ranked: DataFrame, budget: int = 1000) -> DataFrame:
    """The same chunks with ``taken``, the words of each that still fit; the last one is cut."""
    return within_budget(ranked, budget).withColumn("taken", F.least(F.col("n_words").cast("bigint"), F.lit(budget) - F.col("before")))


def text_coverage(evidence: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10), n: int = 5) -> DataFrame:
    """(qid, ev, k, covered, size): the most n-grams of an evidence text that one chunk among the first k holds.
    Evidence of fewer than n tokens is left out. N-grams meet by an equi-join within the question."""
    wanted = evidence.select("qid", "ev", F.array_distinct(ngrams(tokens(F.col("text")), n)).alias("g")).where(F.size("g") > 0)
    sizes = wanted.select("qid", "ev", F.size("g").alias("size"))
    left = wanted.select("qid", "ev", F.explode("g").alias("gram"))
    right = ranked.where(F.col("rank") <= max(ks)).select("qid", "rank", F.explode(F.array_distinct(ngrams(tokens(F.col("text")), n))).alias("gram"))
    shared = left.join(right, ["qid", "gram"]).groupBy("qid", "ev", "rank").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("qid", "ev").agg(*[F.max(F.when(F.col("rank") <= k, F.col("shared"))).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0)).cast("bigint").alias("covered")) for k in ks])).alias("r")
    return sizes.join(best, ["qid", "ev"], "left").select("qid", "ev", rows, "size").select("qid", "ev", "r.k", "r.covered", F.col("size").cast("bigint").alias("size"))


def drawn(seed: str, rep: Column, slot: Column, n: Column) -> Column:
    """The number below n that a repetition draws for a slot: from an md5 of the counters, so that every engine draws
    alike and nothing is stored."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), rep.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("bigint"), n)


def numbered(df: DataFrame, column: str, number: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order of ``column`` (unique), by ranges: each range counts on from the ranges
    before it, so no task sorts them all; the offsets are one number for each range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(parts, column).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["count"]) for r in ranges.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __offset long"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranges.withColumn(number, own).join(offset, "__part").withColumn(number, F.col(number) + F.col("__offset")).drop("__part", "__offset")


def bootstrap(units: DataFrame, sums: list[str], reps: int = 200, seed: str = "1") -> DataFrame:
    """(rep, sums...): sums over n units drawn with replacement, n their number. ``units`` have a column ``unit`` and
    are aggregated beforehand (one row for a company, say), so their number is what a repetition draws."""
    rows = numbered(units.select("unit", *sums), "unit")
    n = rows.count()
    slots = units.sparkSession.range(reps * n).select((F.col("id") / n).cast("bigint").alias("rep"), F.pmod("id", F.lit(n)).alias("slot"))
    picked = slots.select("rep", drawn(seed, F.col("rep"), F.col("slot"), F.lit(n)).alias("number"))
    return picked.join(rows, "number").groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums])


def interval(values: DataFrame, value: str, reps: int) -> DataFrame:
    """(ci_lo, ci_hi): the values at places int(.025 n) and min(int(.975 n), n - 1) of the sorted repetitions."""
    s = values.agg(F.array_sort(F.collect_list(value)).alias("v"))  # one value a repetition
    return s.select(F.element_at("v", int(0.025 * reps) + 1).alias("ci_lo"), F.element_at("v", min(int(0.975 * reps), reps - 1) + 1).alias("ci_hi"))
