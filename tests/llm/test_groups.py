from __future__ import annotations

import hashlib
import math
import random

import pytest

from quillspan.llm import queries, splits, topgroups


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])


def best_of(scores, chunks, n):
    docs = {}
    for c, d in chunks:
        if c is not None:
            docs.setdefault(c, set()).add(d)
    last = {}
    for q, c, s, t in scores:
        if q is not None and c in docs and s is not None and math.isfinite(s):
            key = (t or 0, s)
            last[q, c] = max(last.get((q, c), key), key)
    groups = {}
    for (q, c), (_, s) in last.items():
        doc = min([d for d in docs[c] if d is not None], default=c.split("#")[0])
        groups.setdefault((q, doc), []).append((-s, c))
    return sorted((q, d, c) for (q, d), rows in groups.items() for _, c in sorted(rows)[:n])


def test_top_n_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    chunks = [(f"d{i % 9}#1#{i}", None if i % 5 == 0 else f"d{i % 9}") for i in range(300)] + [("d0#1#0", None), (None, "d1")]
    odd = [None, float("nan"), float("inf"), float("-inf")]
    scores = [("hot" if rng.random() < 0.4 else f"q{rng.randint(0, 20)}", f"d{k % 9}#1#{k}", rng.choice([*odd, *[round(rng.gauss(0, 2), 0) for _ in range(12)]]), rng.randint(1, 9)) for k in (rng.randint(0, 330) for _ in range(4000))]
    scores += scores[:200] + [(None, "d0#1#0", 1.0, 1), ("q1", None, 1.0, 1), ("q1", "d0#1#0", 3.0, None)]
    s = spark.createDataFrame(scores, "soru_id string, chunk_id string, skor double, t long").selectExpr("*", "timestamp_seconds(t) AS yazildi", "'x' AS doc", "1 AS __rank")
    c = spark.createDataFrame(chunks, "chunk_id string, doc string").selectExpr("*", "'x' AS skor")
    for shares in ((0.15, 0.45), (0.01, 0.1, 0.5, 0.9), ()):
        got = topgroups.best_chunks(s, c, 5, shares).select("soru_id", "doc", "chunk_id").collect()
        assert sorted(map(tuple, got)) == best_of(scores, chunks, 5)


def test_top_n_of_empty_tables(spark):
    s = spark.createDataFrame([], "soru_id string, chunk_id string, skor double, yazildi timestamp")
    c = spark.createDataFrame([], "chunk_id string, doc string")
    assert topgroups.best_chunks(s, c).count() == 0


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {x: find(x) for x in list(up)}


def test_edges_of_a_hot_node_are_spread_over_all_parts(spark):
    star = spark.createDataFrame([(f"n{i}", "z") for i in range(3000)], "a string, b string")
    sizes = [len(x) for x in splits.spread(star, 6).rdd.glom().collect()]
    assert len(sizes) == 6 and max(sizes) < 700
    got = splits.components(star, 500).collect()
    assert len(got) == 3000 and {r["component"] for r in got} == {"n0"}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(2)
    edges = {
        "chain": [(f"n{i}", f"n{i + 1}") for i in range(300)],
        "star": [("hub", f"n{i}") for i in range(700)] + [("hub", "n1")],
        "random": [(f"n{rng.randint(0, 800)}", f"n{rng.randint(0, 800)}") for _ in range(500)],
        "loops": [("a", "a"), ("b", "c"), ("c", "b")],
    }[kind]
    edges = [tuple(hashlib.md5(x.encode()).hexdigest() for x in e) for e in edges]
    rows = splits.components(spark.createDataFrame(edges, "a string, b string"), edges_per_part=60).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    got = {r["node"]: r["component"] for r in rows}
    truth = union_find([e for e in edges if e[0] != e[1]])
    named = {}
    for x, root in truth.items():
        named.setdefault(root, set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in named.values()) and len({min(v) for v in named.values()}) == len(named)


def test_question_groups_with_spellings_and_nulls(spark):
    rows = [
        (1, "financebench_id_00000003", "A_2019"), (2, " FINANCEBENCH-ID-00000003", "b 2018"), (3, "financebench_id_00000001", "B_2018.pdf "), (4, "financebench_id_00000009", None),
        (5, None, "a-2019"), (6, None, None), (7, "financebench_id_00000009", ""), (8, "financebench_id_00000007", ".pdf"), (8, "financebench_id_00000007", ".pdf"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "kayit_no bigint, financebench_id string, doc_name string, grup string")
    got = sorted(map(tuple, splits.question_groups(df).collect()), key=lambda r: (r[0], str(r[1])))
    one, nine, seven = (f"financebench_id_0000000{i}" for i in (1, 9, 7))
    assert got == [(1, one), (2, one), (3, one), (4, nine), (5, one), (6, None), (7, nine), (8, seven), (8, seven)]
    assert splits.question_groups(df.limit(0)).count() == 0 and splits.question_parts(df.limit(0), {"a": 1.0}).count() == 0


def test_quotas_are_those_of_the_greedy_rule():
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted(((s, rng.randint(1, 40)) for s in rng.sample(range(1, 60), 8)), reverse=True)
        shares = {"a": 0.8, "b": 0.1, "c": 0.1}
        missing = {k: v * sum(s * c for s, c in sizes) for k, v in shares.items()}
        greedy = {}
        for size, count in sizes:
            for _ in range(count):
                k = max(missing, key=lambda x: missing[x])
                missing[k] -= size
                greedy[size, k] = greedy.get((size, k), 0) + 1
        got = {(s, k): b - a for s, k, a, b in splits.greedy_quotas(sizes, shares)}
        for size, count in sizes:
            assert sum(v for (s, _), v in got.items() if s == size) == count
        held = {k: sum(s * v for (s, x), v in got.items() if x == k) for k in shares}
        assert all(abs(held[k] - sum(s * v for (s, x), v in greedy.items() if x == k)) <= max(s for s, _ in sizes) for k in shares)


def test_parts_keep_groups_whole_and_near_their_shares(spark):
    rows = [(i, f"g{int(random.Random(i).betavariate(1, 3) * 400)}" if i > 900 else "hot") for i in range(3000)]
    members = spark.createDataFrame(rows, "kayit_no bigint, grup string")
    parts = splits.assign_parts(members, "grup", {"egitim": 0.6, "dogrulama": 0.2, "sinama": 0.2}, groups_per_bucket=20)
    joined = members.join(parts, "grup").groupBy("bolum").count().collect()
    assert parts.count() == members.select("grup").distinct().count() == parts.select("grup").distinct().count()
    assert all(abs(r["count"] / 3000 - {"egitim": 0.6, "dogrulama": 0.2, "sinama": 0.2}[r["bolum"]]) < 0.02 for r in joined)
