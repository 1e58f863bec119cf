from __future__ import annotations

import itertools
import random

import numpy as np
from labelled_answers import LABEL
from labelled_documents import KIND
from pyspark.sql import functions as F

from quillspan.llm import defects, leakage, quality
from quillspan.llm.quality_holdout import HOLDOUT


def words(text):
    return [w.decode() for w in leakage.words_of(text)]


def passes(item, others, text, least):
    """A run of ``least`` words or more of the item, found in the text, that no other item has."""
    t = " " + " ".join(text) + " "
    for i in range(len(item)):
        for j in range(i + least, len(item) + 1):
            run = " " + " ".join(item[i:j]) + " "
            if run not in t:
                break
            if all(run not in " " + " ".join(o) + " " for o in others):
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    items = {f"i{k}": [rng.choice(vocabulary) for _ in range(20)] + (shared[: 20 + k * 2] if k < 8 else []) + [rng.choice(vocabulary) for _ in range(30)] for k in range(12)}
    texts = {}
    for n in range(120):
        body = [rng.choice(vocabulary + ["zz"]) for _ in range(rng.randint(0, 60))]
        source = items[rng.choice(list(items))]
        a = rng.randint(0, len(source) - 5)
        piece = source[a : a + rng.randint(5, 45)]
        if n % 4 == 0 and len(piece) > 12:
            piece[len(piece) // 2] = "edited"
        if n % 5 == 0:
            piece = shared[: rng.randint(15, 40)]
        at = rng.randint(0, len(body))
        texts[f"t{n}"] = body[:at] + piece + body[at:]
    rows = [(k, ", ".join(w).upper()) for k, w in texts.items()] + [("t1", ", ".join(texts["t1"])), ("long", "zz " * 50_000 + " ".join(items["i3"])), ("n", None), (None, "x"), ("e", "")]
    texts["long"] = ["zz"] * 40 + items["i3"]
    held = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()] + [("null", None, "x"), (None, "a", "x")], "fb_soru string, metin string, puan string")
    leaked = leakage.leaks(held, spark.createDataFrame(rows, "egitim_id string, text string"), least=12, n=6)
    got = sorted(map(tuple, leakage.found(leaked, 12).collect()))
    want = sorted((i, t) for t, body in texts.items() for i, w in items.items() if passes(w, [o for k, o in items.items() if k != i], body, 12))
    assert got == want and len(want) > 20
    blocks = leakage.leaks(held, spark.createDataFrame(rows, "egitim_id string, text string"), least=12, n=6, block_words=300)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, leaked.collect()))


def test_shared_runs_against_brute_force():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.int32) for _ in range(25)]
    items += [items[0], np.concatenate([items[1], items[2]])]
    got = leakage.shared_suffix(items)
    for k, w in enumerate(items):
        for e in range(len(w)):
            others = [" " + " ".join(map(str, o)) + " " for j, o in enumerate(items) if j != k]
            n = next((n for n in range(e + 1, 0, -1) if any(" " + " ".join(map(str, w[e - n + 1 : e + 1])) + " " in o for o in others)), 0)
            assert got[k][e] == n
    assert leakage.shared_suffix([]) == []


def test_recall_of_edited_copies(spark):
    """Copies of all items with a share of their words changed, dropped or doubled, and short quotations."""
    held = spark.read.parquet("/root/testdata/sf0.1/kilitli_kanit.parquet").select("fb_soru", "metin")
    rng, rows = random.Random(9), []
    for fb, text in held.collect():
        w = words(text)
        for edits in (5, 10, 15, 20, 30):
            copy = [x for y in w for x in ([y] if rng.random() >= edits / 100 else [["edited"], [], [y, y]][rng.randint(0, 2)])]
            rows.append((f"{fb}|{edits}", " ".join(["zz"] * 20 + copy + ["zz"] * 20)))
        for n in (12, 18, 24):
            at = rng.randint(0, len(w) - n)
            rows.append((f"{fb}|quote{n}", " ".join(["zz"] * 20 + w[at : at + n] + ["zz"] * 20)))
    corpus = spark.createDataFrame(rows, "egitim_id string, text string")
    found = {(r["fb_soru"], r["egitim_id"]) for r in leakage.leaks(held, corpus).collect()}
    asked = {}
    for t, _ in rows:
        fb, kind = t.split("|")
        asked.setdefault(kind, []).append((fb, t) in found)
    recall = {k: sum(v) / len(v) for k, v in asked.items()}
    print(recall)
    assert all(recall[str(k)] >= 0.99 for k in (5, 10, 15)) and recall["20"] >= 0.95 and recall["30"] >= 0.9 and recall["quote24"] >= 0.9


def test_copies_edited_every_few_words_are_reported(spark):
    rng = random.Random(3)
    items = {f"i{k}": [f"w{rng.randint(0, 400)}" for _ in range(60)] for k in range(5)}
    texts = {}
    for every in range(6, 11):  # a changed, a dropped and an added word in turn
        for kind in range(3):
            copy = [x for at, w in enumerate(items["i2"]) for x in ([w] if at % every != every - 1 else [["edited"], [], [w, "added"]][kind])]
            texts[f"{every}-{kind}"] = ["zz"] * 30 + copy + ["zz"] * 30
    texts["none"] = ["zz"] * 50 + items["i2"][:5] + ["zz"] * 50
    held = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "fb_soru string, metin string")
    corpus = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "egitim_id string, text string")
    got = {(r["fb_soru"], r["egitim_id"]): r for r in leakage.leaks(held, corpus).collect()}
    assert set(got) == {("i2", t) for t in texts if t != "none"}
    assert all(r["kapsama"] >= 0.8 and not r["gecer"] for r in got.values())


def test_training_texts_and_empty_tables(spark):
    finqa = spark.createDataFrame([("a", ["x"], [["1", None], None, ["2"]], None), ("b", None, None, None)], "id string, pre_text array<string>, tablo array<array<string>>, post_text array<string>")
    docs = spark.createDataFrame([(5, "t"), (6, None)], "doc_id bigint, text string")
    texts = leakage.training_texts(finqa, docs)
    assert sorted((r["egitim_id"], r["text"].split()) for r in texts.collect()) == [("5", ["t"]), ("a", ["x", "1", "2"])]
    held = spark.createDataFrame([], "fb_soru string, metin string")
    assert leakage.leaks(held, texts).count() == 0
    assert leakage.leaks(spark.createDataFrame([("i", "w " * 30)], "fb_soru string, metin string"), texts.limit(0)).count() == 0


def test_alignment_scores_edited_copies():
    item = np.arange(1, 41, dtype=np.int32)
    text = np.concatenate([[0, 0], item[:15], [0], item[17:], [0]]).astype(np.int32)
    got = leakage.align([text, item], [item, item], [np.full(40, 25), np.full(40, 25)])
    assert got["en_uzun"].tolist() == [23, 40] and got["puan"].tolist() == [2 * 38 - 1 - 1, 80]
    assert got["ortak"].tolist() == [38, 40] and got["gecer"].tolist() == [False, True]


def test_statistics_of_odd_texts():
    s = quality.Statistics()
    values = s([None, "", " \n\t", "a", "x" * 300_000, "| a | 1 |\n| b | 2 |", "…", "\ud800"])
    assert values.shape == (8, len(quality.STATISTICS)) and np.isfinite(values).all()
    assert (values[:3] == 0).all() and values[4][quality.STATISTICS.index("long_share")] == 1
    one_by_one = np.vstack([s([t]) for t in ("a b. c", "1;2;3\n4;5;6", "Menu\nHome")])
    assert np.allclose(one_by_one, s(["a b. c", "1;2;3\n4;5;6", "Menu\nHome"]))


def test_kinds_on_a_holdout_and_empty_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    stats = quality.measured(docs)
    model = quality.KindModel(stats, sample_rows=600)
    held = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(HOLDOUT)], "doc_id bigint, text string, kind string")
    best = model.probabilities(quality.measured(held)).toPandas()
    found = best[[f"p_{k}" for k in quality.KINDS]].to_numpy().argmax(axis=1)
    assert np.mean([quality.KINDS[a] == k for a, k in zip(found, best["kind"])]) > 0.93
    empty = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id bigint, text string")
    assert quality.not_prose(empty).count() == 0 and quality.not_prose(empty.limit(0)).count() == 0


def test_documents_that_rules_leave_open(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    judged = quality.judged(docs)
    by_rule = {r["doc_id"] for r in quality.weak_labels(judged.where(F.col("doc_id").isin(*KIND))).collect()}
    got = {r["doc_id"]: r["tur"] for r in judged.where(F.col("doc_id").isin(*KIND)).collect()}
    right = sum(got[k] == kind for k, kind in KIND.items())
    print(right, {k: (kind, got[k]) for k, kind in KIND.items() if got[k] != kind})
    assert not by_rule and len(got) == len(KIND) == 41 and right >= 39


QUESTION = "What is the FY2019 net revenue in millions of Foo Group? Use the table."
ANSWERS = [
    (None, "bos"), ("", "bos"), (" \n", "bos"), ("**Final answer:** ", "bos"), ("```\n```", "bos"), ("Final answer:\nSources:", "bos"), ("...", "bos"),
    (QUESTION, "kopya"), (f"> {QUESTION.upper()}\n", "kopya"), (f"Question: {QUESTION}\nSources: none", "kopya"), (QUESTION.replace(" ", "  "), "kopya"),
    ("I'm sorry, but I can't help with that request.", "ret"), ("Final answer: cannot be determined", "ret"), ("The pages given lacks the details needed. I am unable to state this figure.", "ret"),
    ("The segment table supports this reading. We first take $3 million from the bal", "kesik"), ("The segment table supports this reading.\n\nFinal answer:", "kesik"),
    ("The segment table supports this reading.\nFinal answer: $5.2 million\nSources: FOO_2019", "kesik"),
    ("On prend d'abord la moyenne des deux années.\n\nFinal answer: 5,2 millions de dollars", "dil"), ("Belgede verilen tutar aşağıdaki gibidir.\nFinal answer: 5,2", "dil"),
    ("Final answer: 5.2", None), ("$5.2 million", None), ("The segment table supports this reading.\nFinal answer: $5.2 million\nSources: FOO_2019, page 3", None),
    ("I cannot verify the audit opinion itself, but the figure is stated plainly.\nFinal answer: 5.2 million dollars", None),
]


def test_defects(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/cevaplar.parquet").select("kayit_no", "id", "yanit")
    asked = spark.read.parquet("/root/testdata/sf0.01/sorular.parquet").select("financebench_id", "question").union(spark.createDataFrame([("own", QUESTION), (None, "x")], "i string, q string"))
    own = spark.createDataFrame([(-i - 1, "own", a) for i, (a, _) in enumerate(ANSWERS)] + [(-100, "unknown", "Final answer: 3"), (-101, None, "x " * 50_000), (None, "own", "5.2")], "kayit_no bigint, id string, yanit string")
    found = defects.tagged(real.union(own), asked).where("kayit_no < 0 OR kayit_no IS NULL").collect()
    got = {r["kayit_no"]: r["kusur"] for r in found}
    assert [(a, got[-i - 1]) for i, (a, _) in enumerate(ANSWERS)] == ANSWERS
    assert got[-100] is None and -101 in got and None in got
    assert defects.tagged(real.limit(0), asked.limit(0)).count() == 0


def test_answers_labelled_by_hand(spark):
    answers = spark.read.parquet("/root/testdata/sf0.1/cevaplar.parquet").select("kayit_no", "id", "yanit")
    asked = spark.read.parquet("/root/testdata/sf0.1/sorular.parquet").select("financebench_id", "question")
    held = answers.where(F.col("kayit_no").isin(*LABEL))
    model = defects.trained(answers.where(~F.col("kayit_no").isin(*LABEL)), asked, 4000)
    got = {r["kayit_no"]: r["kusur"] for r in defects.tagged(held, asked, model=model).collect()}
    texts = held.join(defects.first_questions(asked), "id", "left").select("kayit_no", "yanit", "question").collect()
    rules = {}
    for r in texts:
        record = defects.Record(r["yanit"], r["question"])
        tags = defects.weak_tags(record) if record.content else []
        rules[r["kayit_no"]] = "open" if tags is None else defects.defect(record, tags)[0]
    right = sum(got[k] == kind for k, kind in LABEL.items())
    by_rules = max(sum((open_ if rules[k] == "open" else rules[k]) == kind for k, kind in LABEL.items()) for open_ in (None, "kesik"))
    assert len(LABEL) == 310 and right >= 301 and right > by_rules + 20


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(0)
    c = defects.Crf()
    k = len(defects.TAGS)
    c.w[:8], c.pair, c.first, c.last = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k)
    sequences = [[[1, 2], [3], [4, 5]], [[2]], [], [[3, 1], [4], [6], [7, 1]]]
    for s, got in zip(sequences, c.best(sequences)):
        score = lambda t: sum(c.w[f, t[i]] for i, fs in enumerate(s) for f in fs) + c.first[t[0]] + c.last[t[-1]] + sum(c.pair[a, b] for a, b in zip(t, t[1:]))
        assert got == (list(max(itertools.product(range(k), repeat=len(s)), key=score)) if s else [])
    taught = defects.Crf().fit([sequences[0], sequences[1], sequences[3]], [[0, 1, 2], [3], [5, 4, 0, 1]], steps=300)
    assert taught.best([sequences[0], sequences[3]]) == [[0, 1, 2], [5, 4, 0, 1]]
