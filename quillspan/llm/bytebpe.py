"""Byte-level BPE encoding of a whole corpus by speculation and verification.

Every distinct word of a batch is first split by greedy longest match. A sequence of tokens is what the merges would
give exactly if each two neighbours stay apart when the pair is encoded alone, so all pairs of all proposals are
tested together in numpy, and only the words with a failing pair go through the merges one by one.

Null and empty texts have an empty list of ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: White space of the Unicode property White_Space, and the split pattern that the vocabulary was made with.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WIDE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts of ASCII only, where the standard library's engine is faster.
ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Characters that are encoded at a time, and words that a worker remembers; bounds of memory only.
SLICE_CHARS = 1_000_000
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    folder = folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    return os.path.join(folder, name)


@dataclass
class Vocabulary:
    """Tokens by bytes; ``left`` and ``right`` are the two tokens a token was merged from (itself, if a single byte);
    ``pair_keys`` and ``pair_ids`` are the merges, sorted by ``left * size + right``."""

    ids: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    #: The longest token that begins with these one or two bytes.
    longest: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.left)


def merge(word: bytes, ids: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Exact merging of one word: the pair that makes the lowest id is joined first, the leftmost of equals. Open pairs wait in a
    heap and parts are linked to their neighbours, so a word of n bytes takes about n log n steps."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    limit = 1 << 62 if below is None else below
    get = ids.get
    heap = [(made, i, i + 1) for i in range(n - 1) if (made := get(word[i : i + 2], limit)) < limit]
    heapq.heapify(heap)
    while heap:
        made, i, j = heapq.heappop(heap)
        a, b = parts[i], parts[j]
        if a is None or b is None or after[i] != j or get(a + b) != made:
            continue  # one of the two has been joined to something else
        parts[i], parts[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (made := get(parts[i] + parts[k], limit)) < limit:
                heapq.heappush(heap, (made, i, k))
        if (h := before[i]) >= 0 and (made := get(parts[h] + parts[i], limit)) < limit:
            heapq.heappush(heap, (made, h, i))
    return [p for p in parts if p is not None]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
    size = max(ids.values()) + 1
    left, right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
    keys, made = [], []
    for token, i in ids.items():
        if len(token) > 1:
            halves = merge(token, ids, below=i)
            if len(halves) == 2:
                left[i], right[i] = ids[halves[0]], ids[halves[1]]
                keys.append(left[i] * size + right[i])
                made.append(i)
    longest: dict[bytes, int] = {}
    for token in ids:
        longest[token[:2]] = max(longest.get(token[:2], 1), len(token))
    order = np.argsort(np.array(keys, dtype=np.int64))
    return Vocabulary(ids, left, right, np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order], longest)


def stay_apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the merges keep each pair (a, b) as these two tokens.

    The merges across the border are undone from the last backwards: while both sides stand as x and y, the border is
    in danger if (x, y) makes a token earlier than the next merge of either side would have replaced x or y.
    """
    x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    limit = np.full(len(x), np.iinfo(np.int64).max)
    apart = np.ones(len(x), dtype=bool)
    live = np.arange(len(x))
    while len(live):
        lx, ly = x[live], y[live]
        at = np.searchsorted(v.pair_keys, lx * v.size + ly)
        at[at == len(v.pair_keys)] = 0
        made = np.where(v.pair_keys[at] == lx * v.size + ly, v.pair_ids[at], np.iinfo(np.int64).max)
        joined = made < limit[live]
        apart[live[joined]] = False
        live, lx, ly = live[~joined], lx[~joined], ly[~joined]
        # The later merge is undone first; of equal tokens the left one was merged first, so the right is undone first.
        whole_x, whole_y = v.right[lx] == lx, v.left[ly] == ly
        undo_x = ~whole_x & (whole_y | (lx > ly))
        undo_y = ~whole_y & ~undo_x
        limit[live] = np.where(undo_x, lx, np.where(undo_y, ly + 1, limit[live]))
        x[live] = np.where(undo_x, v.right[lx], lx)
        y[live] = np.where(undo_y, v.left[ly], ly)
        live = live[undo_x | undo_y]
    return apart


class Encoder:
    """Encodes texts; remembers the words it has met as one flat array of ids with a start and a length each."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.ascii, self.wide = re.compile(ASCII), regex.compile(WIDE)
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.wide).findall(text)

    def longest_match(self, word: bytes) -> list[int]:
        ids, longest, out, i, n = self.v.ids, self.v.longest, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                found = ids.get(word[i:j])
                if found is not None:
                    out.append(found)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.code]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        known = self.v.ids
        proposals = [[known[w]] if w in known else self.longest_match(w) for w in raw]
        n = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(new)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[inner[~stay_apart(self.v, flat[inner], flat[inner + 1])]])
        if len(bad):
            for k in bad:
                proposals[k] = [known[p] for p in merge(raw[k], known)]
            n = np.fromiter(map(len, proposals), np.int64, len(proposals))
            flat = np.fromiter((t for p in proposals for t in p), np.int64, int(n.sum()))
        base = len(self.code)
        self.code.update(zip(new, range(base, base + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts as codes, and the number of words of each text."""
        split = [self.words(t) if t else [] for t in texts]
        met = set().union(*split)
        if len(self.code) > REMEMBERED:
            self._forget()
        self.learn(met)
        n = np.fromiter(map(len, split), np.int64, len(split))
        get = self.code.__getitem__
        return np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(n.sum())), n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it."""
        codes, n = self.codes(texts)
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])
        return ids, at[np.concatenate([[0], np.cumsum(n)])]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_CHARS characters; a longer text is a run of its own."""
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "") + 1
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``ids`` (array<int>), or with ``counts_only`` ``n_tokens`` (bigint).

    One narrow stage: no row leaves its partition. The vocabulary (a fixed table of 50,256 tokens) is broadcast.
    Rows come out one for one: repeated rows are encoded again, a null id is kept.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary or vocabulary_path()))
    kept = [id_col, *keep]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a, b in slices(texts):
                columns = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                ids, bounds = encoder.encode(texts[a:b])
                if counts_only:
                    columns.append(pa.array(np.diff(bounds), pa.int64()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens" if counts_only else "ids"])

    source = df.select(*kept, df[text_col].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(encode, f"{schema}, {'n_tokens bigint' if counts_only else 'ids array<int>'}")
