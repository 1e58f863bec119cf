from __future__ import annotations

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspan.llm import bytebpe, packing

tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = bytebpe.vocabulary_path()
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts() -> list[str | None]:
    rng = random.Random(3)
    letters = "abcdefghij éßİ中0123½Ⅷ \n\t'ABTHEtion.,-_\U0001f600’\x1c\x85\xa0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return made + [None, "", " ", "don't 'LL we'll", "a" * 500, "<|endoftext|>", "x " * 30_000, "ab" * 20_000, "\x00\x01", "same", "same"]


def test_ids_equal_a_public_library(spark, reference):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r["ids"] for r in bytebpe.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t, _ in rows}


def test_failing_words_need_and_get_exact_merges():
    v = bytebpe.load_vocabulary(VOCABULARY)
    e = bytebpe.Encoder(v)
    words = [w for t in texts() if t for w in e.words(t)]
    changed = [w for w in set(words) if e.longest_match(w.encode()) != [v.ids[p] for p in bytebpe.merge(w.encode(), v.ids)]]
    assert changed  # longest match alone is not enough
    ids, _ = e.encode(changed)
    assert ids.tolist() == [v.ids[p] for w in changed for p in bytebpe.merge(w.encode(), v.ids)]


def test_one_very_long_word_takes_seconds(reference):
    rng = random.Random(8)
    word = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    began = time.time()
    ids, _ = bytebpe.Encoder(bytebpe.load_vocabulary(VOCABULARY)).encode([word, word[:5000] + "."])
    assert time.time() - began < 60
    tail = reference.encode_ordinary(word[:5000] + ".")
    assert ids[-len(tail) :].tolist() == tail
    assert b"".join(reference.decode_single_token_bytes(int(i)) for i in ids[: -len(tail)]) == word.encode()


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bytebpe.encode_corpus(empty, "doc_id", "text").count() == 0
    assert packing.pack(empty.withColumn("source", F.lit("s"))).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    assert bytebpe.encode_corpus(one, "doc_id", "text", counts_only=True).collect()[0]["n_tokens"] == 2


def packed(spark, rows, capacity):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, container string, shard string")
    return packing.pack(df, capacity=capacity).toPandas()


def test_containers_hold_every_piece_once_and_never_too_much(spark):
    rng = random.Random(5)
    rows = [(i, " word" * rng.randint(0, 90), rng.choice(["hot"] * 6 + ["a", "b", None]), "x", "y") for i in range(900)]
    rows += [(2**60 + 1, " word" * 1000, "hot", "x", "y"), (901, None, None, "x", "y"), (902, "", "a", "x", "y"), (None, " word" * 5, "a", "x", "y")]
    got = packed(spark, rows, 128)
    fill = got.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 128
    assert set(got["doc_id"].dropna().astype("int64")) >= {901, 902}
    assert got["n_tokens"].sum() == sum((t or "").count("word") for _, t, *_ in rows)
    pieces = got.groupby("doc_id")["piece"].count()
    assert all(n == 1 for i, n in pieces.items() if i < 2**59)  # only the text longer than a container is divided
    for _, box in got[got["n_tokens"] > 0].sort_values("at").groupby("container"):
        assert (box["at"].iloc[1:].to_numpy() == (box["at"] + box["n_tokens"]).iloc[:-1].to_numpy()).all()
    assert fill.sum() / (128 * len(fill[fill > 0])) > 0.95


def test_a_hot_source_keeps_its_share_in_every_container(spark):
    rows = [(i, " word" * (10 + i % 7), "hot" if i % 3 == 0 else "cold", "x", "y") for i in range(3000)]
    got = packed(spark, rows, 256)
    hot = got[got["source"] == "hot"].groupby("container")["n_tokens"].sum()
    share = (hot / got.groupby("container")["n_tokens"].sum()).fillna(0)
    assert abs(share.mean() - 1 / 3) < 0.03 and (abs(share - 1 / 3) < 0.1).mean() > 0.9
