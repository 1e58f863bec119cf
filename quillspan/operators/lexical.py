"""BM25 over whole corpora: term statistics, and top k for a stated set of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import tokens
from quillspan.operators.ranking import ranked
from quillspan.session import written

#: Texts that a task scores at a time, and kinds of questions that are broadcast at a time.
PIECE, BLOCK = 65_536, 16_384
COUNTED = "chunk_id string, dl int, terms array<int>, tfs array<int>"
FOUND = "kind string, chunk_id string, score double"
#: What a score may gain by being rounded to six places, with room for sums in another order.
SLACK = 1e-5


def postings(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, tf, dl): a row for each distinct term of each text, dl its number of tokens."""
    split = texts.select(*key, tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    return split.select(*key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(*key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(posts: DataFrame, n_texts: int) -> DataFrame:
    """(term, df, idf) with idf = ln((N - df + 0.5) / (df + 0.5)), at least 0."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.greatest(F.log((F.lit(n_texts) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0)))


def best_terms(terms: DataFrame, k: int) -> DataFrame:
    """The rarest terms of each query, up to where they stand in ten times k texts: what its first guess is made from."""
    before = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    return terms.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("before") < 10 * k).drop("before")


def counted(texts: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(chunk_id, dl, terms, tfs): a row for each text with a token, dl its number of tokens; terms are the ``numbers`` of those
    tokens that have one, each once, and tfs say how often they stand there."""
    shared = texts.sparkSession.sparkContext.broadcast(numbers)
    schema = pa.schema([("chunk_id", pa.string()), ("dl", pa.int32()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, split = shared.value.get, re.compile("[a-z0-9]+").findall  # of lower-case text: what tokens() gives
        n_terms = max(len(shared.value), 1)
        for batch in batches:
            found = [split(t) for t in batch.column("text").to_pylist()]
            dl = np.fromiter(map(len, found), np.int32, len(found))
            at = np.fromiter(map(number, chain.from_iterable(found), repeat(-1)), np.int64, int(dl.sum()))
            pairs, tf = np.unique((np.repeat(np.arange(len(dl)), dl) * n_terms + at)[at >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(dl) + 1) * n_terms).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % n_terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").cast(pa.string()), pa.array(dl), *lists], schema=schema).filter(pa.array(dl > 0))

    return texts.where("text IS NOT NULL").select("chunk_id", F.lower("text").alias("text")).mapInArrow(count, COUNTED)


class Piece:
    """Texts in the order of their ids, and their weights by term."""

    def __init__(self, rows: pa.Table, idf: np.ndarray, average: float, k1: float, b: float):
        rows = rows.sort_by("chunk_id").combine_chunks()
        self.names = rows.column("chunk_id")
        lists = rows.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.float64)
        place = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        dl = rows.column("dl").to_numpy().astype(np.float64)[place]
        counts = idf[term] > 0
        term, tf, dl, place = term[counts], tf[counts], dl[counts], place[counts]
        order = np.argsort(term, kind="stable")
        self.place, weight = place[order], idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
        self.weight, self.start = weight[order], np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.most = np.zeros(len(idf))
        np.maximum.at(self.most, term, weight)
        self.sums = np.zeros(rows.num_rows)

    def listed(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[self.start[term] : self.start[term + 1]], self.weight[self.start[term] : self.start[term + 1]]

    def best(self, terms: np.ndarray, qtfs: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best texts that reach the score ``least``; equal scores in the order of the ids.

        The terms whose greatest weights together stay under ``least`` bring no text by themselves: they are looked up only
        for the texts that the other terms bring near enough. Sums are made in the order of ``terms`` either way."""
        most = self.most[terms] * qtfs
        order = np.argsort(most)
        idle = np.zeros(len(terms), bool)
        idle[order] = np.cumsum(most[order]) < least - SLACK
        if idle.all() or not most.any():
            return np.empty(0, np.int64), np.empty(0)
        self.sums[:] = 0
        for term, qtf in zip(terms[~idle], qtfs[~idle]):
            place, weight = self.listed(term)
            self.sums[place] += weight * qtf
        found = np.flatnonzero(self.sums > max(least - SLACK - most[idle].sum(), 0))
        score = self.sums[found]
        if idle.any() and len(found):
            score = np.zeros(len(found))
            for term, qtf in zip(terms, qtfs):
                place, weight = self.listed(term)
                if len(place):
                    at = np.minimum(np.searchsorted(place, found), len(place) - 1)
                    score += np.where(place[at] == found, weight[at] * qtf, 0)
        score = np.floor(score * 1e6 + 0.5) / 1e6
        if len(found) > k:
            kept = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[kept], score[kept]
        order = np.argsort(-score, kind="stable")[:k]
        return found[order], score[order]


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def best_by_kind(posts: DataFrame, kinds: list[str], idf: np.ndarray, average: float, k: int, k1: float, b: float, size: int) -> DataFrame:
    """(kind, chunk_id, score): of each task the k best of its texts for each kind of question."""
    shared = posts.sparkSession.sparkContext.broadcast((kinds, idf))
    schema = pa.schema([("kind", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, idf = shared.value
        asked = [np.array([x.split(":") for x in kind.split(" ")], np.int64).T for kind in kinds]
        held: list[list[tuple[float, str]]] = [[] for _ in kinds]
        for rows in pieces(batches, size):
            piece = Piece(rows, idf, average, k1, b)
            for i, (terms, qtfs) in enumerate(asked):
                place, score = piece.best(terms, qtfs, k, -held[i][-1][0] if len(held[i]) == k else 0.0)
                if len(place):
                    held[i] = sorted(held[i] + list(zip((-score).tolist(), piece.names.take(place).to_pylist())))[:k]
        for i in range(0, len(kinds), 1024):
            some = [(kind, name, -score) for kind, h in zip(kinds[i : i + 1024], held[i : i + 1024]) for score, name in h]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)

    return posts.mapInArrow(best, FOUND)


def bm25(queries: DataFrame, texts: DataFrame, k: int = 10, within: str | None = None, k1: float = 1.5, b: float = 0.75, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(query, chunk_id, score, rank) of ``queries`` (query, question) in ``texts`` (chunk_id, text, ...). The term
    statistics are those of all texts; with ``within`` only texts of the query's own value of that column count.

    Texts are split once and one row for each is written: its counts of the terms that queries hold. Queries that hold the
    same terms with any weight are one kind and are scored once. A task scores its texts a piece at a time against each kind
    and keeps the k best, so neither postings nor hits go between executors. The result is exact. The distinct terms of the
    queries and their kinds pass through the driver, kinds in blocks.
    """
    if within:
        return bm25_within(queries, texts, within, k, k1, b)
    asked = queries.select("query", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked, spark = written(asked, "asked"), texts.sparkSession
    names = asked.select("term").distinct().toArrow().column("term").to_pylist()
    posts = written(counted(texts, {term: i for i, term in enumerate(names)}), "postings")
    n, average = posts.agg(F.count(F.lit(1)), F.avg("dl")).first()
    known = idf(posts.select(F.explode("terms").alias("term")), n).where("idf > 0").select("term", "idf").toArrow()
    number, weight = known.column("term").to_numpy(), np.zeros(len(names))
    weight[number] = known.column("idf").to_numpy()
    if not len(number):
        return spark.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, chunk_id string, score double, rank int")
    numbers = spark.createDataFrame(pa.table({"term": pa.array([names[i] for i in number], pa.string()), "number": pa.array(number, pa.int32())}))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("number", "qtf"))), lambda x: F.concat_ws(":", x["number"], x["qtf"]))
    kind = written(asked.join(numbers, "term").groupBy("query").agg(F.array_join(parts, " ").alias("kind")), "kinds")
    kinds = kind.select("kind").distinct().toArrow().column("kind").to_pylist()
    held = posts.where(F.size("terms") > 0)
    blocks = [best_by_kind(held, kinds[i : i + block], weight, average, k, k1, b, piece) for i in range(0, len(kinds), block)]
    best = ranked(reduce(DataFrame.unionByName, blocks), ["kind"], [F.desc("score"), F.asc("chunk_id")], k)
    return best.join(kind, "kind").select("query", "chunk_id", "score", "rank")


def bm25_within(queries: DataFrame, texts: DataFrame, within: str, k: int, k1: float, b: float) -> DataFrame:
    """bm25() where only texts of the query's own value of ``within`` count.

    Texts are split once: the postings of the terms that queries hold, and a mark for each text, are written. A first score by
    each query's rarest terms gives a score that its k-th text reaches at least. The terms whose best weights together stay
    under it can bring no text by themselves, so only texts with another term of the query are candidates, and frequent terms
    are looked up for these alone: what is joined grows with the candidates, not with texts times queries. The result is exact.
    """
    own = [within]
    asked = queries.select("query", *own, F.explode(tokens(F.col("question"))).alias("term"))
    asked = asked.groupBy(*asked.columns).agg(F.count(F.lit(1)).alias("qtf"))
    mark = texts.sparkSession.createDataFrame([("",)], "term string")
    split = texts.select("chunk_id", *own, tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    spread = split.select("chunk_id", *own, F.size("w").alias("dl"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    held = spread.join(asked.select("term").distinct().unionByName(mark), "term", "left_semi")
    posts = written(held.groupBy("chunk_id", *own, "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, average = posts.where("term = ''").agg(F.count(F.lit(1)), F.avg("dl")).first()
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average or 1.0)))
    weighed = posts.where("term <> ''").join(idf(posts.where("term <> ''"), n or 0).where("idf > 0"), "term")
    weighed = written(weighed.select("term", "chunk_id", *own, "df", weight.alias("weight")), "weights")
    terms = weighed.groupBy("term").agg(F.max("df").alias("df"), F.max("weight").alias("most"))
    wanted = written(asked.join(terms, "term"), "asked")

    def scored(hits: DataFrame) -> DataFrame:
        return hits.groupBy("query", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("qtf")), 6).alias("score"))

    def hits(some: DataFrame) -> DataFrame:
        return some.select("query", *own, "term", "qtf").join(weighed, ["term", *own])

    first = ranked(scored(hits(best_terms(wanted, k))), ["query"], [F.desc("score"), F.asc("chunk_id")], k)
    reached = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("reached"))
    upto = Window.partitionBy("query").orderBy(F.col("most") * F.col("qtf"), "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = wanted.withColumn("bound", F.sum(F.col("most") * F.col("qtf")).over(upto)).join(reached, "query", "left")
    needed = bound.where(F.col("bound") >= F.coalesce("reached", F.lit(0.0)) - 1e-5)
    candidates = hits(needed).select("query", "chunk_id").distinct()
    every = candidates.join(weighed.select("chunk_id", "term", "weight"), "chunk_id").join(wanted.select("query", "term", "qtf"), ["query", "term"])
    return ranked(scored(every), ["query"], [F.desc("score"), F.asc("chunk_id")], k)
