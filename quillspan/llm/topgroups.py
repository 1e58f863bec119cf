"""Top N items of every group by descending score bands.

The scores are cut into ranges at quantiles and the candidates are written once, one folder per band. Bands are then
worked from the top: groups that are filled already are anti-joined away where the band is read, ahead of sort and shuffle, the
rest is cut to N per group in each task before it is shuffled, and the band in which a group fills up is finished by exact
ranking (score descending, then id ascending). Equal scores always share a band, so the bands never decide a tie.

The filled groups are sent to the tasks only up to ``SENT_GROUPS`` of them; where there are more, a band is cut to N per group in
each task first and then meets them by their keys, so no more than N rows of a group and task are shuffled either way.

Defined results: null, NaN and infinite scores and null ids or group keys are no candidates; a repeated (group, id)
must be reduced beforehand (``latest_score``); groups with fewer than N items keep all; an empty input gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ranking import finite, latest_score
from quillspan.session import written


#: Filled groups that are broadcast to the readers of a band, at most.
SENT_GROUPS = 100_000


def band_cuts(scores: DataFrame, score: str, shares: tuple[float, ...]) -> list[float]:
    """Scores above which about each of ``shares`` of the rows lie; sketches, never rows, reach the driver."""
    if not shares:
        return []
    found = scores.select(F.col(score).cast("double").alias("s")).where(finite(F.col("s"))).approxQuantile("s", [1 - x for x in shares], 0.01)
    return sorted(set(found), reverse=True)


def top_n(candidates: DataFrame, group: list[str], item: str, score: str, n: int, cuts: list[float]) -> DataFrame:
    """``group``, ``item`` and ``score`` of the N best rows of each group. ``cuts`` are descending lower ends of bands;
    the last band has no lower end."""
    c = candidates.select(*group, item, score)
    band = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        band = F.when(F.col(score) >= cuts[k], k).otherwise(band)
    banded = written(c.withColumn("__band", band.cast("int")), "bands", ["__band"])
    best_first = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(item))
    done: list[DataFrame] = []
    for k in range(len(cuts) + 1):
        rows = banded.where(F.col("__band") == k).drop("__band")
        have = reduce(DataFrame.unionByName, done).groupBy(*group).agg(F.count(F.lit(1)).alias("__have")) if done else None
        filled, sent = None, False
        if have is not None:
            have = written(have, "have")
            filled = have.where(F.col("__have") >= n).select(*group)
            sent = filled.count() <= SENT_GROUPS
        if sent:
            rows = rows.join(F.broadcast(filled), group, "left_anti")
        # The filter on the row number becomes a limit per group inside each task, ahead of the shuffle.
        rows = rows.withColumn("__rank", F.row_number().over(best_first)).where(F.col("__rank") <= n)
        if have is not None:
            if not sent:
                rows = rows.join(filled, group, "left_anti")
            rows = rows.join(have.where(F.col("__have") < n), group, "left").where(F.col("__rank") <= n - F.coalesce(F.col("__have"), F.lit(0)))
        rows = rows.select(*group, item, score)
        done.append(written(rows, f"band-{k}") if k < len(cuts) else rows)
    return reduce(DataFrame.unionByName, done)


def best_chunks(scores: DataFrame, chunks: DataFrame, n: int = 5, shares: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """(soru_id, doc, chunk_id, skor): the N best scored chunks of every question and document.

    A null ``doc`` is the part of ``chunk_id`` before the first ``#``; repeated chunks count once; scores of unknown
    chunks fall out with the join.
    """
    known = chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("doc").alias("doc"))
    known = known.select("chunk_id", F.coalesce("doc", F.substring_index("chunk_id", "#", 1)).alias("doc"))
    once = latest_score(scores, ["soru_id", "chunk_id"], "skor", "yazildi")
    return top_n(once.join(known, "chunk_id"), ["soru_id", "doc"], "chunk_id", "skor", n, band_cuts(scores, "skor", shares))
