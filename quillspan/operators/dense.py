"""Exact vector search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.ranking import ranked

#: Queries of one block, and rows of one piece of the corpus: what a task holds at a time.
BLOCK, PIECE = 1024, 65_536
FOUND = "query bigint, vec_id bigint, score double"


def normalised(vector: Column) -> Column:
    """The vector over its length, in doubles; null for null and for a vector without length."""
    doubles = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length))


def with_length(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Those of ``rows`` whose vector has a length, and their vectors over their lengths."""
    vectors = np.stack(rows["embedding"]).astype(np.float64)
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return rows[length > 0], vectors[length > 0] / length[length > 0, None]


def best_of(ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray | None, rows: pd.DataFrame, k: int, same: str | None) -> pd.DataFrame:
    """The k best ``rows`` of each query; with ``same`` only rows of its own label."""
    rows, theirs = with_length(rows)
    score = np.round(vectors @ theirs.T, 9)
    if same:
        score = np.where(labels[:, None] == rows[same].to_numpy()[None, :], score, -np.inf)
    vec = rows["vec_id"].to_numpy()
    order = np.lexsort((np.broadcast_to(vec, score.shape), -score), axis=1)[:, :k]
    at = np.repeat(np.arange(len(ids)), order.shape[1])
    found = pd.DataFrame({"query": ids[at], "vec_id": vec[order.ravel()], "score": score[at, order.ravel()]})
    return found[found["score"] > -np.inf]


def meet(asked: DataFrame, rows: DataFrame, on: list[str], k: int, same: str | None, blocks: int, pieces: int) -> DataFrame:
    """(query, vec_id, score): the k best of every pair of a block of queries and a piece of rows that agree in ``on``. Both
    sides go from executor to executor, and a task holds one block and one piece."""
    keys = [*on, "__block", "__piece"]
    left = asked.withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))))
    right = rows.withColumn("__piece", F.pmod(F.xxhash64("vec_id"), F.lit(pieces))).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def pair(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        mine, vectors = with_length(mine)
        return best_of(mine["query"].to_numpy(), vectors, mine[same].to_numpy() if same else None, theirs, k, same)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, FOUND)


def search(queries: DataFrame, corpus: DataFrame, k: int, same: str | None = None, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(query, vec_id, score, rank) by cosine. ``queries`` are (query, embedding[, same]) and ``corpus`` (vec_id, embedding[,
    same]); with ``same`` only vectors with the query's value there count, filtered before the top k.

    One block of queries is broadcast and the corpus is read where it lies; more blocks meet pieces of the corpus on the
    executors. A task keeps its k best for each query either way. Null vectors and such without length fall out.
    """
    columns = [same] if same else []
    asked = queries.select("query", "embedding", *columns).where("embedding IS NOT NULL")
    rows = corpus.select("vec_id", "embedding", *columns).where("embedding IS NOT NULL")
    n = asked.count()
    if n > block:
        found = meet(asked, rows, [], k, same, -(-n // block), max(1, -(-corpus.count() // piece)))
        return ranked(found, ["query"], [F.desc("score"), F.asc("vec_id")], k)
    mine = asked.toPandas().sort_values("query", ignore_index=True)  # at most one block
    if not len(mine):
        return corpus.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    mine, vectors = with_length(mine)
    shared = corpus.sparkSession.sparkContext.broadcast((mine["query"].to_numpy(), vectors, mine[same].to_numpy() if same else None))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield best_of(*shared.value, batch, k, same)

    return ranked(rows.mapInPandas(best, FOUND), ["query"], [F.desc("score"), F.asc("vec_id")], k)
