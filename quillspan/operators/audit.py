"""Audit of training examples against filings and held-out items, and a split by company."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import ngrams, tokens
from quillspan.operators.ranking import ranked


def company_years(examples: DataFrame) -> DataFrame:
    """(id, ticker, year, bolum) from ids of the form ``TICKER/YEAR/page_N.pdf-k``; other ids fall out."""
    parts = [F.regexp_extract("id", r"^([^/]+)/(\d{4})/page_\d+\.pdf-\d+$", k) for k in (1, 2)]
    return examples.select("id", parts[0].alias("ticker"), parts[1].alias("y"), "bolum").where("ticker <> ''").select("id", "ticker", F.col("y").cast("int").alias("year"), "bolum")


def containment(examples: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(id, item, shared, size, containment): distinct n-grams that an example shares with an item, over all of the
    example's. ``examples`` are (id, text), ``items`` (item, text); they meet by the n-gram, so only pairs that share
    one are formed."""
    grams = lambda df, key: df.select(key, F.array_distinct(ngrams(tokens(F.col("text")), n)).alias("g"))
    own = grams(examples, "id")
    left, right = own.select("id", F.size("g").alias("size"), F.explode("g").alias("gram")), grams(items, "item").select("item", F.explode("g").alias("gram"))
    pairs = left.join(right, "gram").groupBy("id", "item", "size").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.select("id", "item", "shared", F.col("size").cast("bigint").alias("size"), (F.col("shared") / F.col("size")).alias("containment"))


def best_containment(pairs: DataFrame) -> DataFrame:
    """The example with the highest containment for each item; ties by id."""
    return ranked(pairs, ["item"], [F.desc("containment"), F.asc("id")], 1).drop("rank")


def split_search(counts: DataFrame, target: int, seeds: int, salt: str = "s") -> DataFrame:
    """(seed, group, members, score) of the best of several random splits. ``counts`` are (grp, kind, n); for each seed
    the groups are taken in the order of an md5 of seed and group until they hold ``target`` members; the score is
    the distance from the target and from a like share of every kind. Ties go to the lowest seed.

    Groups are aggregated before they are spread over the seeds, so a seed sorts one row a group."""
    totals = counts.groupBy("grp").agg(F.sum("n").alias("n"))
    spread = totals.select("grp", "n", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    order = Window.partitionBy("seed").orderBy(F.md5(F.concat_ws("|", F.lit(salt), F.col("seed").cast("string"), "grp")))
    taken = spread.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < target)
    kinds = taken.join(counts.select("grp", "kind", F.col("n").alias("k")), "grp").groupBy("seed", "kind").agg(F.sum("k").alias("k"))
    share = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    everything = counts.agg(F.sum("n")).first()[0] or 1
    spread_kinds = share.select("kind", "total", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).join(kinds, ["seed", "kind"], "left")
    off = spread_kinds.groupBy("seed").agg(F.sum(F.abs(F.coalesce("k", F.lit(0)) * everything - F.col("total") * target)).alias("off"))
    held = taken.groupBy("seed").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("groups"))
    scored = held.join(off, "seed").withColumn("score", F.abs(F.col("members") - target) * everything + F.col("off"))
    return scored.orderBy("score", "seed").limit(1).select("seed", "groups", "members", "score")
