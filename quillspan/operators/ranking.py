"""Rankings: latest scores, top k, fusion, depth-limited reranking, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def latest_score(scores: DataFrame, keys: list[str], score: str, time: str) -> DataFrame:
    """One row per ``keys`` with the finite score of the latest ``time``; a null time is the earliest, and of equal
    times the higher score counts. The aggregation is partial before the shuffle, so hot pairs arrive reduced."""
    order = F.struct(F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp")).alias("t"), F.col(score).cast("double").alias("s"))
    kept = scores.where(finite(F.col(score).cast("double")) & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return kept.groupBy(*keys).agg(F.max(order)["s"].alias(score))


def ranked(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; cut to k in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def fused(rankings: list[DataFrame], group: str, item: str, k: int = 100, damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (damping + rank) over the rankings; ties by item."""
    both = reduce(DataFrame.unionByName, [r.select(group, item, "rank") for r in rankings])
    scored = both.groupBy(group, item).agg(F.sum(1 / (F.lit(damping) + F.col("rank"))).alias("fused"))
    return ranked(scored, [group], [F.desc(F.round("fused", 12)), F.asc(item)], k)


def reranked(ranking: DataFrame, scores: DataFrame, group: str, item: str, score: str, depth: int) -> DataFrame:
    """The first ``depth`` of a ranking in the order of ``score``, the rest as it was; equal scores keep their order."""
    joined = ranking.join(scores.select(group, item, score), [group, item], "left")
    head = F.col("rank") <= depth
    return ranked(joined, [group], [F.when(head, 0).otherwise(1), F.desc(F.when(head, F.col(score))), F.asc("rank")], 2**31 - 1, "new_rank")


def overlap_at(a: DataFrame, b: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """For each group of ``a``: how many of its first k are among the first k of ``b``, and out of how many."""
    first = a.where(F.col("rank") <= k).select(group, item)
    other = b.where(F.col("rank") <= k).select(group, item, F.lit(1).alias("hit"))
    return first.join(other, [group, item], "left").groupBy(group).agg(F.count("hit").alias("shared"), F.count(F.lit(1)).alias("size"))
