"""Approximate vector search: an inverted file of cells around centroids.

The centroids are fitted by k-means on a bounded sample (``sample_rows``, chosen by a hash of the id), about as many as the
square root of the rows; every row is then put into its nearest cell and the index is written by cell. A query meets the rows of
its ``probes`` nearest cells only, by the cell's number, in pieces that a task can hold. Defined results are those of
``dense.search``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.dense import BLOCK, PIECE, meet, normalised
from quillspan.operators.ranking import overlap_at, ranked
from quillspan.session import written


def centroids(corpus: DataFrame, sample_rows: int = 20_000, seed: int = 1) -> np.ndarray:
    """Centres of the cells, one row each: about the square root of the number of rows, at most a tenth of the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.select("vec_id", normalised(F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")
    total = rows.count()
    key = F.xxhash64("vec_id")
    sample = rows.where(F.pmod(key, F.lit(max(1, total // sample_rows))) == 0).orderBy(key, "vec_id").limit(2 * sample_rows)
    vectors = sample.select(array_to_vector("embedding").alias("features")).coalesce(1).cache()
    n = vectors.count()
    cells = max(1, min(round(total**0.5), n // 10))
    centres = KMeans(k=cells, maxIter=10, seed=seed).fit(vectors).clusterCenters() if cells > 1 else [np.asarray(r["features"]) for r in vectors.limit(1).collect()]
    vectors.unpersist()
    return np.stack(centres) if len(centres) else np.empty((0, 0))


def celled(rows: DataFrame, key: str, centres: np.ndarray, cells: int) -> DataFrame:
    """(key, embedding, cell): every vector with each of its nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (shared.value**2).sum(axis=1) / 2
        for batch in batches:
            if len(batch) and len(half):
                near = np.argsort(half - np.stack(batch["embedding"]) @ shared.value.T, axis=1, kind="stable")[:, :cells]
                yield batch.iloc[np.repeat(np.arange(len(batch)), near.shape[1])].assign(cell=near.ravel().astype(np.int32))

    vectors = rows.select(key, normalised(F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")
    return vectors.mapInPandas(assign, f"{key} bigint, embedding array<double>, cell int")


def indexed(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index (vec_id, embedding, cell) of every row that has a vector, written in ranges of cells; a cell that holds many rows
    lies in several ranges."""
    return written(celled(corpus, "vec_id", centres, 1).repartitionByRange("cell", "vec_id"), "vector-index")


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(query, vec_id, score, rank): the k best rows of each query's nearest cells."""
    n = queries.count()
    largest = index.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    found = meet(celled(queries, "query", centres, probes), index, ["cell"], k, None, max(1, -(-n // block)), max(1, -(-largest // piece)))
    return ranked(found, ["query"], [F.desc("score"), F.asc("vec_id")], k)


def compared(queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(rows): how many pairs of a query and a row a search with so many probes looks at."""
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return celled(queries, "query", centres, probes).join(sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, shared, size): how many of the exact first k were found."""
    return overlap_at(exact, found, "query", "vec_id", k)
