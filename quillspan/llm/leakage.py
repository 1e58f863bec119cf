"""Held-out evaluation texts inside a training corpus.

1. Seeds. For every end of a word run in an item, the shortest run of at least ``least`` words that occurs in no other
   item must hold at least one seed: the n-gram that is rarest among the items (of equals the one with the smallest
   hash). No passage can be missed, and wording that items share brings in no candidates of its own.
   Edited copies need shorter seeds: all n-grams of ``short`` words that are in one item only. Two of them that do not
   overlap, near one diagonal of a text and an item, make a pair; a copy with a changed word every ``short`` + 1 words has them.
2. Scan. Each training text is cut into words where it lies; only regions around seed hits leave the task, as numbers
   of item words.
3. Join. Hits meet the seed table by the n-gram's hash and give pairs of region and item.
4. Alignment. Smith-Waterman over words scores each pair in numpy, many pairs at a time, so edited copies are scored
   too; alongside runs the length of the exact run that ends at each pair of words, which decides ``gecer``.

The items are a benchmark (150 rows in this project) and are numbered on the driver, four bytes a word. What an item's own runs and
rare n-grams are is found over all items; ``BLOCK_WORDS`` bounds what is broadcast, and a larger set is worked in blocks of
items, each against the whole corpus, with the same result.

Defined results: null or empty texts and items take part in nothing; repeated training rows give each pair once; an
item without a run that is its own cannot leak; empty tables give no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import written

#: Bytes of words, and of the mark that parts texts; all other bytes, also those of wider characters, become blanks.
KEPT = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789A" else 32 for b in range(256))
BORDER, SLICE_CHARS = " A ", 2_000_000
BLOCK_WORDS = 1_000_000
MATCH, OTHER, GAP = 2, -1, -1
#: Words of a short seed, and how far the diagonals of two neighbouring short hits may lie apart.
SHORT, SLIP = 5, 8


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z and 0-9 in the lower-case text; ``A`` is in no lower-case text and stays free for BORDER."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(KEPT).split()


def joined(texts: list[str | None]) -> list[bytes]:
    """The words of all texts, with a border before and after each."""
    low = BORDER.join(["", *((t or "").lower() for t in texts), ""])
    return low.encode("utf-8", "surrogatepass").translate(KEPT).split()


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_CHARS characters."""
    begin = chars = 0
    for i, size in enumerate(sizes):
        chars += size
        if chars >= SLICE_CHARS or i == len(sizes) - 1:
            yield begin, i + 1
            begin, chars = i + 1, 0


def shared_suffix(items: list[np.ndarray]) -> list[np.ndarray]:
    """For each item and each position, how many words up to and including it also stand in another item in a row. Positions are
    ordered by the words that lead up to them (ranks of runs of 1, 2, 4 ... words); the nearest of another item share most."""
    if not items:
        return []
    size = np.array([len(w) for w in items])
    item, place = np.repeat(np.arange(len(items)), size), np.concatenate([np.arange(n) for n in size])
    ranks, width = [np.unique(np.concatenate(items), return_inverse=True)[1].astype(np.int64)], 1
    while width < size.max():
        earlier = np.where(place >= width, ranks[-1][np.maximum(np.arange(len(item)) - width, 0)] + 1, 0)
        ranks.append(np.unique(ranks[-1] * (len(item) + 1) + earlier, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
    live = np.ones(len(common), bool)
    for k in range(len(ranks) - 1, -1, -1):
        same = live & (ranks[k][a] == ranks[k][b])
        left = place[a] + 1
        common += np.where(same, np.minimum(left, 1 << k), 0)
        live &= ~(same & (left <= 1 << k))  # both have come to the beginning of their items
        a, b = np.where(same & live, a - (1 << k), a), np.where(same & live, b - (1 << k), b)
    longest, who = [0] * len(order), item[order].tolist()
    for steps, at, before in ((common.tolist(), range(1, len(order)), -1), (common.tolist()[::-1], range(len(order) - 2, -1, -1), 1)):
        best = 0
        for c, i in zip(steps, at):
            best = c if who[i + before] != who[i] else min(c, best)
            longest[i] = max(longest[i], best)
    found = np.empty(len(order), np.int64)
    found[order] = longest
    return np.split(found, np.cumsum(size)[:-1])


def grams(ids: np.ndarray, n: int, mix: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of word numbers, put together from halves; ``mix`` has a random number for each
    word, the last one for the border of two texts."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    width, power, whole, done = 1, mix[ids], None, 0
    while True:  # the binary digits of n say which powers of two make up the n-gram
        if n & width:
            k = len(ids) - done - width + 1
            whole = power[:k] if whole is None else whole[:k] * np.uint64(0x9E3779B97F4A7C15) + power[done : done + k]
            done += width
        if done == n:
            return whole ^ (whole >> np.uint64(29))
        power = power[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + power[width:] + np.uint64(width)
        width *= 2


class Benchmark:
    """The held-out items in numbers: words, shortest own runs and seeds, in blocks of items of about ``BLOCK_WORDS``."""

    def __init__(self, rows: list[tuple[str, str | None]], least: int, n: int, short: int | None = None):
        split = {k: w for k, t in rows if k is not None and len(w := words_of(t)) >= least}
        self.n, self.least, self.short, self.names = n, least, short, sorted(split)
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for x in split.values() for w in x}))}
        self.mix = np.random.default_rng(7).integers(1, 2**63, len(self.number) + 2, dtype=np.uint64) | np.uint64(1)
        self.items = [np.array([self.number[w] for w in split[k]], np.int32) for k in self.names]
        self.longest = max(map(len, self.items), default=0)
        #: The least length of a run that ends at a position and is no other item's.
        self.own = [np.maximum(least, s + 1) for s in shared_suffix(self.items)]
        hashed = [grams(w, n, self.mix) for w in self.items]
        met, in_items = counted(hashed)
        self.seeds: list[tuple[int, str, int]] = []
        for name, h, own in zip(self.names, hashed, self.own):
            rarity = in_items[np.searchsorted(met, h)]
            order = np.lexsort((h, rarity))
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            chosen = {a + int(np.argmin(rank[a : e - n + 2])) for e in range(least - 1, len(own)) if (a := e - int(own[e]) + 1) >= 0}
            self.seeds += [(int(h[i].astype(np.int64)), name, i) for i in sorted(chosen)]
        #: Short seeds, sorted by hash: the hash, the item and the place in it of every n-gram that only one item has.
        few = [grams(w, short, self.mix) for w in self.items] if short else []
        met, in_items = counted(few)
        gram = np.concatenate(few or [np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(few)), [len(h) for h in few])
        place = np.concatenate([np.arange(len(h)) for h in few] or [np.empty(0, np.int64)])
        own = np.flatnonzero(np.isin(gram, met[in_items == 1]))
        own = own[np.argsort(gram[own], kind="stable")]
        self.few = gram[own], item[own], place[own]

    def blocks(self, words: int) -> Iterator[Benchmark]:
        """The benchmark cut into blocks of items of at least ``words`` words; runs and seeds stay those of the whole."""
        ends = np.cumsum([len(w) for w in self.items]) // max(1, words)
        for block in np.unique(ends) if len(self.items) else [0]:
            which = np.flatnonzero(ends == block)
            part = copy.copy(self)
            part.names, part.items, part.own = ([x[i] for i in which] for x in (self.names, self.items, self.own))
            kept, named = {int(w) for x in part.items for w in np.unique(x)}, set(part.names)
            part.number = {w: i for w, i in self.number.items() if i in kept}
            part.longest = max(map(len, part.items), default=0)
            part.seeds = [s for s in self.seeds if s[1] in named]
            mine = np.isin(self.few[1], which)
            part.few = self.few[0][mine], np.searchsorted(which, self.few[1][mine]), self.few[2][mine]
            yield part


def counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams, and in how many items each stands."""
    return np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.empty(0, np.uint64)]), return_counts=True)


def near(at: np.ndarray, text: np.ndarray, h: np.ndarray, few: tuple[np.ndarray, np.ndarray, np.ndarray], short: int) -> np.ndarray:
    """Those of the places ``at`` (their text, and their hash among ``few``) that lie with others of the same text and
    item near one diagonal (steps of at most SLIP) and span two n-grams that do not overlap."""
    gram, item, place = few
    low, high = np.searchsorted(gram, h, "left"), np.searchsorted(gram, h, "right")
    hit = np.repeat(np.arange(len(at)), high - low)
    seed = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    t, k, where = text[hit], item[seed], at[hit]
    diagonal = where - place[seed]
    order = np.lexsort((where, diagonal, k, t))
    if not len(order):
        return at[:0]
    t, k, where, diagonal = t[order], k[order], where[order], diagonal[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(t) != 0) | (np.diff(k) != 0) | (np.diff(diagonal) > SLIP)]))
    wide = np.maximum.reduceat(where, begin) - np.minimum.reduceat(where, begin) >= short
    return np.unique(where[np.repeat(wide, np.diff(np.append(begin, len(where))))])


def scan(texts: DataFrame, b: Benchmark) -> DataFrame:
    """(egitim_id, region, words, hits) of the regions of ``texts`` (egitim_id, text) that hold seeds."""
    spark = texts.sparkSession
    number, mix, n, pad = b.number, b.mix, b.n, b.longest
    seeds = np.unique(np.array([s for s, _, _ in b.seeds], np.int64).astype(np.uint64))
    sieve = np.zeros(1 << 20, bool)
    sieve[seeds >> np.uint64(44)] = True
    short, short_sieve = b.short, np.zeros(1 << 20, bool)
    short_sieve[b.few[0] >> np.uint64(44)] = True
    shared = spark.sparkContext.broadcast((number, mix, seeds, sieve, b.few, short_sieve))

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, mix, seeds, sieve, few, short_sieve = shared.value
        number = {**number, b"A": -1}
        for batch in batches:
            keys, texts, out = batch["egitim_id"].tolist(), batch["text"].tolist(), []
            for begin, end in runs([len(t or "") for t in texts]):
                said = joined(texts[begin:end])
                ids = np.fromiter(map(number.get, said, repeat(0)), np.int32, len(said))
                border = np.flatnonzero(ids == -1)
                h = grams(ids, n, mix)
                at = np.flatnonzero(sieve[h >> np.uint64(44)])
                at = at[np.isin(h[at], seeds)]
                found = [(int(i), int(h[i].astype(np.int64))) for i in at]
                if short:
                    g = grams(ids, short, mix)
                    some = np.flatnonzero(short_sieve[g >> np.uint64(44)])
                    some = some[np.isin(g[some], few[0])]
                    some = near(some, np.searchsorted(border, some) - 1, g[some], few, short)
                    found = sorted(found + [(int(i), int(g[i].astype(np.int64))) for i in some])
                    at = np.array([i for i, _ in found], np.int64)
                text = np.searchsorted(border, at) - 1
                far = (np.diff(at) > n + 2 * pad) | (np.diff(text) > 0)
                for which in np.split(np.arange(len(at)), np.flatnonzero(far) + 1) if len(at) else []:
                    part = at[which]
                    k = int(np.searchsorted(border, part[0])) - 1
                    first, last = max(int(border[k]) + 1, int(part[0]) - pad), min(int(border[k + 1]), int(part[-1]) + n + pad)
                    hits = [{"seed": found[i][1], "at": found[i][0] - first} for i in which]
                    out.append((keys[begin + k], first - int(border[k]) - 1, ids[first:last], hits))
            yield pd.DataFrame(out, columns=["egitim_id", "region", "words", "hits"])

    return texts.mapInPandas(regions, "egitim_id string, region int, words array<int>, hits array<struct<seed: bigint, at: int>>")


def align(words: list[np.ndarray], items: list[np.ndarray], own: list[np.ndarray]) -> pd.DataFrame:
    """Best local alignment of each pair: its score, the words matched in it, the longest exact run, and whether a
    run is the item's own. A cell holds score * CELL + words matched, so one maximum settles both."""
    m, n = max(map(len, words)), max(map(len, items))
    # The words matched must not run into the score.
    kind, CELL = (np.int32, 8192) if max(m, n) < 8192 else (np.int64, 1 << 31)
    a, b, need = np.full((len(words), m), -1, np.int32), np.full((len(words), n), -2, np.int32), np.full((len(words), n), n + m, np.int32)
    for k, (w, i, o) in enumerate(zip(words, items, own)):
        a[k, : len(w)], b[k, : len(i)], need[k, : len(i)] = w, i, o
    cell, run, best, longest = (np.zeros((len(words), m + 1), kind) for _ in range(4))
    passes = np.zeros((len(words), m + 1), bool)
    slope = -GAP * CELL * np.arange(m + 1, dtype=kind)
    for i in range(n):
        same = a == b[:, i : i + 1]
        now = np.zeros_like(cell)
        np.maximum(cell[:, :-1] + np.where(same, kind(MATCH * CELL + 1), kind(OTHER * CELL)), cell[:, 1:] + GAP * CELL, out=now[:, 1:])
        now[now < CELL] = 0
        # A gap along the text: the best earlier cell of this row, less a cost for each word in between.
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        cell = now
        run[:, 1:] = (run[:, :-1] + 1) * same
        np.maximum(best, cell, out=best)
        np.maximum(longest, run, out=longest)
        passes |= run >= need[:, i : i + 1]
    top = best.max(axis=1).astype(np.int64)
    return pd.DataFrame({"puan": top // CELL, "ortak": top % CELL, "en_uzun": longest.max(axis=1).astype(np.int64), "gecer": passes.any(axis=1)})


def leaks(items: DataFrame, texts: DataFrame, least: int = 25, n: int = 12, short: int | None = SHORT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(fb_soru, egitim_id, puan, ortak, en_uzun, kapsama, gecer): every pair of an item and a training text that
    share a seed, or two short ones apart near one diagonal (none are looked for where ``short`` is None; exact runs do not
    need them). ``puan`` is the alignment's score, ``ortak`` the words it matches, ``kapsama`` their share of the
    item, ``en_uzun`` the longest exact run, ``gecer`` whether a run of ``least`` words or more is the item's own."""
    whole = Benchmark([(r[0], r[1]) for r in items.select("fb_soru", "metin").distinct().collect()], least, n, short)
    return reduce(DataFrame.unionByName, [leaks_of(b, texts) for b in whole.blocks(block_words)])


def leaks_of(b: Benchmark, texts: DataFrame) -> DataFrame:
    """The leaks of one block of items."""
    spark: SparkSession = texts.sparkSession
    found = written(scan(texts, b).withColumn("body", F.xxhash64("words")), "regions")
    few = [(int(h), b.names[k], int(i)) for h, k, i in zip(b.few[0].astype(np.int64), b.few[1], b.few[2])]
    seeds = F.broadcast(spark.createDataFrame(b.seeds + few, "seed long, fb_soru string, item_at int"))  # about two rows for a word of the block
    hits = found.select("egitim_id", "region", "body", F.explode("hits").alias("hit")).select("egitim_id", "region", "body", "hit.*").join(seeds, "seed")
    diagonal = F.col("at") - F.col("item_at")
    pairs = hits.groupBy("egitim_id", "region", "body", "fb_soru").agg(F.min(diagonal).alias("low"), F.max(diagonal).alias("high"))
    regions = found.select("egitim_id", "region", "body", "words").dropDuplicates(["egitim_id", "region", "body"])
    place = {name: k for k, name in enumerate(b.names)}
    shared = spark.sparkContext.broadcast((place, b.items, b.own))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, items, own = shared.value
        for batch in batches:
            # The part of the region that the item can cover from its hits, with a quarter of its length to spare.
            length = np.array([len(items[place[x]]) for x in batch["fb_soru"]], np.int64)
            low, high = batch["low"].to_numpy() - length // 4, batch["high"].to_numpy() + length + length // 4
            batch = batch.assign(words=[w[max(0, a) : b] for w, a, b in zip(batch["words"], low, high)])
            size = batch["words"].map(len)
            batch = batch.iloc[np.argsort(size.to_numpy(), kind="stable")]
            begin = 0
            while begin < len(batch):
                # About 100,000 cells a row, however long the regions are.
                step = max(1, 100_000 // (max(1, len(batch["words"].iloc[begin])) + 100))
                part = batch.iloc[begin : begin + step]
                at = [place[x] for x in part["fb_soru"]]
                result = align(part["words"].tolist(), [items[k] for k in at], [own[k] for k in at])
                result["kapsama"] = result["ortak"] / np.array([len(items[k]) for k in at])
                yield pd.concat([part[["fb_soru", "egitim_id"]].reset_index(drop=True), result], axis=1)
                begin += step

    scored = pairs.join(regions, ["egitim_id", "region", "body"]).select("fb_soru", "egitim_id", "low", "high", "words")
    scored = scored.mapInPandas(score, "fb_soru string, egitim_id string, puan bigint, ortak bigint, en_uzun bigint, gecer boolean, kapsama double")
    best = F.max(F.struct("puan", "ortak", "en_uzun", "kapsama")).alias("best")
    return scored.groupBy("fb_soru", "egitim_id").agg(best, F.max("gecer").alias("gecer")).select("fb_soru", "egitim_id", "best.*", "gecer")


def training_texts(finqa: DataFrame, documents: DataFrame) -> DataFrame:
    """(egitim_id, text): table cells row by row between the two lists of passages, joined by blanks."""
    cells = F.transform("tablo", lambda row: F.concat_ws(" ", row))
    examples = finqa.select(F.col("id").alias("egitim_id"), F.concat_ws(" ", "pre_text", cells, "post_text").alias("text"))
    return examples.unionByName(documents.select(F.col("doc_id").cast("string").alias("egitim_id"), "text")).where("egitim_id IS NOT NULL AND text <> ''")


def found(leaked: DataFrame, least: int = 25) -> DataFrame:
    """The pairs with a whole passage: an exact run of ``least`` words alone scores MATCH each, so the score sieves
    first and the exact run decides."""
    return leaked.where((F.col("puan") >= MATCH * least) & F.col("gecer")).select("fb_soru", "egitim_id")
