"""Packing of texts into containers of one fixed number of tokens, with a controlled mixture of sources.

Deficit round-robin over one queue per source: each next text comes from the source that is furthest below its share
of the tokens packed so far (the largest of its texts that fits), until that source has nothing that fits; the rest
of the window is closed by the largest fitting text of any source, which is charged to its source. Deficits go on from
window to window. Shards are packed in parallel: a shard packs all its texts, so what it uses of each source is known
beforehand, and the deficits with which a shard begins are the sums over the shards before it.

A text longer than a container is cut into full containers and a rest, which is packed as an item. Windows that end
up less full than ``close_at`` are opened again and their items are packed together in a second round, so that the loss is
a few containers per ITEMS_PER_SHARD left-over items and not per shard. The second round begins with the deficits of the first.

With many sources and few texts in a window no single window can hold all of them; the proportions hold over runs of windows
(``mixture``), as each window goes on where the one before it stopped.

Defined results: texts without tokens (null, empty) take no room and lie at the start of the first window of their
shard; a null source is a source; repeated texts are texts; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import bytebpe
from quillspan.session import written

#: Items that one task packs, at about, and the least number of shards of the first round.
ITEMS_PER_SHARD, LEAST_SHARDS = 20_000, 6


def fill(source: list[str], size: list[int], used: dict[str, float], share: dict[str, float], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of every item of one shard; ``used`` is what each source has had too much of so far."""
    window, offset = [0] * len(size), [0] * len(size)
    order = sorted((i for i in range(len(size)) if size[i]), key=lambda i: (size[i], i))
    everything = [(size[i], i) for i in order]
    queues: dict[str, list[tuple[int, int]]] = {}
    for i in order:
        queues.setdefault(source[i], []).append((size[i], i))
    used = {s: used.get(s, 0.0) for s in queues}
    due = [(used[s] / share[s], s) for s in queues]
    heapq.heapify(due)
    k, room = 0, capacity
    while everything:
        while due and (due[0][1] not in queues or due[0][0] != used[due[0][1]] / share[due[0][1]]):
            heapq.heappop(due)  # an emptied queue, or a place in the line that the closing of a window has changed
        s = due[0][1]
        j = bisect.bisect_right(queues[s], (room, len(size))) - 1
        if j < 0:  # the source that is due has nothing that fits
            g = bisect.bisect_right(everything, (room, len(size))) - 1
            if g < 0:
                k, room = k + 1, capacity
                continue
            s = source[everything[g][1]]
            j = bisect.bisect_left(queues[s], everything[g])
        item = queues[s].pop(j)
        everything.pop(bisect.bisect_left(everything, item))
        window[item[1]], offset[item[1]] = k, capacity - room
        room -= item[0]
        used[s] += item[0]
        if queues[s]:
            heapq.heappush(due, (used[s] / share[s], s))
        else:
            del queues[s]
        if not room:
            k, room = k + 1, capacity
    return window, offset


def packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        first = items.drop_duplicates("source").set_index("source")
        window, offset = fill(items["source"].tolist(), items["n_tokens"].tolist(), first["used"].to_dict(), first["share"].to_dict(), capacity)
        items = items.assign(window=window, at=offset)
        return items.assign(filled=items.groupby("window")["n_tokens"].transform("sum"))[["doc_id", "source", "piece", "n_tokens", "share", "shard", "window", "at", "filled"]]

    return pack


#: Shards that share one prefix sum.
SHARDS_PER_BLOCK = 1024


def carried(items: DataFrame, base: DataFrame | None) -> DataFrame:
    """(shard, source, used): what each source has had beyond its share when a shard begins, from the shards before it and from
    ``base`` (source, t), the tokens packed in earlier rounds. Tokens are summed by shard first; sums over shards are built
    within blocks of shards and over the blocks, so that no task orders them all."""
    by_source = items.groupBy("shard", "source").agg(F.sum("n_tokens").alias("t"), F.first("share").alias("share")).withColumn("block", F.floor(F.col("shard") / SHARDS_PER_BLOCK))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    all_of = by_source.groupBy("block", "shard").agg(F.sum("t").alias("all"))
    blocks = all_of.groupBy("block").agg(F.sum("all").alias("all")).agg(F.collect_list(F.struct("block", "all")).alias("blocks"))  # one entry for SHARDS_PER_BLOCK shards
    earlier = F.aggregate(F.filter("blocks", lambda b: b["block"] < F.col("block")), F.lit(0).cast("bigint"), lambda x, b: x + b["all"])
    all_of = all_of.crossJoin(blocks).select("shard", (F.coalesce(F.sum("all").over(inside), F.lit(0)) + earlier).alias("all"))
    known = by_source.join(all_of, "shard")
    if base is None:
        return known.select("shard", "source", (F.coalesce(F.sum("t").over(before), F.lit(0)) - F.col("share") * F.col("all")).alias("used"))
    whole = base.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("whole"))
    known = known.join(base.select("source", F.col("t").alias("had")), "source", "left").crossJoin(whole)
    had = F.coalesce("had", F.lit(0)) + F.coalesce(F.sum("t").over(before), F.lit(0))
    return known.select("shard", "source", (had - F.col("share") * (F.col("all") + F.col("whole"))).alias("used"))


def pack_round(items: DataFrame, shards: int, capacity: int, base: DataFrame | None = None) -> DataFrame:
    """One round: items carry ``share``, the target of their source; the deficits of earlier shards and rounds are carried along."""
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    kinds = "doc_id string, source string, piece int, n_tokens bigint, share double, shard bigint, window int, at bigint, filled bigint"
    return items.join(carried(items, base), ["shard", "source"]).groupBy("shard").applyInPandas(packer(capacity), kinds)


def pack(documents: DataFrame, capacity: int = 4096, targets: DataFrame | None = None, close_at: float = 0.97, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, piece, n_tokens, container, at): where each piece of each text lies.

    ``targets`` (source, share) are the token proportions to keep to while a source lasts; by default those of the
    corpus. A source that ``targets`` lacks has the least share given.
    """
    return packed(documents, capacity, targets, close_at, vocabulary).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "piece", "n_tokens", F.concat_ws("-", "round", "shard", "window").alias("container"), "at")


def packed(documents: DataFrame, capacity: int, targets: DataFrame | None, close_at: float, vocabulary: str | None) -> DataFrame:
    """The same with round, shard, window and the source's share."""
    # Ids travel as text, so that pandas keeps nulls and large numbers apart.
    plain = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    sizes = written(bytebpe.encode_corpus(plain, "doc_id", "text", vocabulary, counts_only=True, keep=("source",)), "sizes")
    texts, tokens = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if targets is None:
        share = sizes.groupBy("source").agg((F.greatest(F.sum("n_tokens"), F.lit(1)) / max(1, tokens)).alias("share"))
        least = 1.0 / max(1, tokens)
    else:
        share = targets.where("share > 0").groupBy("source").agg(F.max("share").cast("double").alias("share"))
        least = share.agg(F.min("share")).first()[0] or 1.0
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0)))).alias("piece")
    items = sizes.select("doc_id", "source", F.col("n_tokens").alias("n"), cut)
    items = items.select("doc_id", "source", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    items = items.join(share, "source", "left").select("doc_id", "source", "piece", "n_tokens", F.coalesce("share", F.lit(least)).alias("share"))
    first = written(pack_round(items, max(LEAST_SHARDS, -(-texts // ITEMS_PER_SHARD)), capacity), "packed")
    closed = first.where(F.col("filled") >= int(close_at * capacity))
    again = first.where(F.col("filled") < int(close_at * capacity)).select("doc_id", "source", "piece", "n_tokens", "share")
    second = pack_round(again, max(1, -(-again.count() // ITEMS_PER_SHARD)), capacity, closed.groupBy("source").agg(F.sum("n_tokens").alias("t")))
    return closed.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


def mixture(placed: DataFrame, run: int) -> DataFrame:
    """(round, shard, run, tokens, distance) of every ``run`` windows in a row of a packing: the total variation between the
    tokens of each source in it and the sources' shares (summing to 1 over the sources that the packing has)."""
    at = placed.withColumn("run", F.floor(F.col("window") / run)).groupBy("round", "shard", "run", "source").agg(F.sum("n_tokens").alias("t"), F.first("share").alias("share"))
    tokens = F.sum("t").alias("tokens")
    # A source that a run lacks counts with its whole share: half the sum over those it has, and half of what is left.
    runs = at.withColumn("all", F.sum("t").over(Window.partitionBy("round", "shard", "run"))).where("all > 0").groupBy("round", "shard", "run")
    off = F.sum(F.abs(F.col("t") / F.col("all") - F.col("share"))) + F.greatest(F.lit(0.0), 1 - F.sum("share"))
    return runs.agg(tokens, (off / 2).alias("distance"))
