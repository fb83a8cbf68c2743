import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts import session
from adfacts.functions import tokens as X
from adfacts.operators import examples as E


@pytest.fixture(scope="module")
def sequences(spark):
    random.seed(5)
    sizes = [0, 1, 5, 500, 510, 511, 512, 513, 1000, 1023, 1024, 1025, 1919, 1920, 2200, 2816, 4000]
    rows = [
        (i, [random.randrange(2, 99) for _ in range(n)], [random.randrange(2, 99) for _ in range(i % 4)])
        for i, n in enumerate(sizes)
    ]
    return rows, spark.createDataFrame(rows, "id int, p array<int>, c array<int>")


@pytest.mark.parametrize("cap", [None, 2047])
def test_supervised(sequences, cap):
    rows, df = sequences
    out = {r["id"]: r for r in E.supervised(df, F.col("p"), F.col("c"), cap=cap).collect()}
    for i, p, c in rows:
        ids = (p + c + [X.END])[:512]
        padded = ids + [X.PAD] * (512 - len(ids))
        hidden = min(len(p), 511 if cap is None else cap, 512)
        assert out[i]["input_ids"] == padded
        assert out[i]["attention_mask"] == [1] * len(ids) + [0] * (512 - len(ids))
        assert out[i]["labels"] == [-100] * hidden + padded[hidden:]
        if cap is None:
            assert any(x != -100 for x in out[i]["labels"])


def test_classification(sequences):
    rows, df = sequences
    df = df.withColumn("label", F.element_at(F.array(F.lit("onsite"), F.lit("OnSite"), F.lit("HYBRID")), F.col("id") % 3 + 1))
    out = {r["id"]: r for r in E.classification(df, F.col("p"), F.col("c"), F.col("label")).collect()}
    for i, p, c in rows:
        ids = p + c
        ids = ids if len(ids) <= 1024 else ids[:896] + ids[-128:]
        padded = ids + [0] * (1024 - len(ids))
        cut = min(len(p), 896)
        labels = [-100] * cut + [-100 if x == 0 else x for x in padded[cut:]]
        assert out[i]["input_ids"] == padded and out[i]["labels"] == labels
        assert out[i]["cls_labels"] == [0, 0, 2][i % 3] and out[i]["task_type_id"] == 1


def test_generation_windows(sequences):
    rows, df = sequences
    full = F.concat("p", "c", F.array(F.lit(1)))
    out = {(r["id"], r["start"]): r for r in E.generation(df, F.col("p"), full).collect()}
    want = {}
    for i, p, c in rows:
        ids = p + c + [1]
        if len(ids) <= 1024:
            want[i, 0] = (ids, len(p))
            continue
        for start in range(0, len(ids), 896):
            chunk = ids[start : start + 1024]
            if len(chunk) < 128:
                break
            want[i, start] = (chunk, len(p) if start == 0 else 0)
    assert set(out) == set(want)
    for key, (chunk, cut) in want.items():
        padded = chunk + [0] * (1024 - len(chunk))
        cut = min(cut, 1024)
        assert out[key]["input_ids"] == padded
        assert out[key]["attention_mask"] == [1] * len(chunk) + [0] * (1024 - len(chunk))
        assert out[key]["labels"] == [-100] * cut + [-100 if x == 0 else x for x in padded[cut:]]


def test_vocabulary_and_encoding(spark):
    docs = [(1, "b a a ."), (2, "c b a"), (3, ""), (4, None), (5, "é 日本 - x")]
    df = spark.createDataFrame(docs, "id int, text string").select(
        "id", X.tokens(F.col("text")).alias("tokens")
    )
    vocab = E.vocabulary(df)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda x: x[1])] == [
        "a", "b", "-", ".", "c", "x", "é", "日本",
    ]
    assert sorted(ids.values()) == list(range(2, 10))
    out = {r["id"]: r["input_ids"] for r in E.encoded(df, vocab, "id").collect()}
    assert out == {
        1: [ids["b"], ids["a"], ids["a"], ids["."]], 2: [ids["c"], ids["b"], ids["a"]],
        3: [], 4: [], 5: [ids["é"], ids["日本"], ids["-"], ids["x"]],
    }


def test_encoding_past_the_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT_TOKENS", 2)
    random.seed(9)
    docs = [(i, [f"t{min(random.randrange(40), random.randrange(40))}" for _ in range(30)]) for i in range(50)]
    df = spark.createDataFrame(docs, "id int, tokens array<string>")
    vocab = E.vocabulary(df)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    out = {r["id"]: r["input_ids"] for r in E.encoded(df, vocab, "id").collect()}
    assert out == {i: [ids[t] for t in ts] for i, ts in docs}


def test_encoding_of_long_unknown_and_repeated_tokens(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT_TOKENS", 3)
    monkeypatch.setattr(E, "HOT_LETTERS", 4)
    docs = [(1, ["a", "letters", None, "z", "a", "z", "new"]), (1, ["letters"] * 5), (None, ["b", "z", "b"]), (2, None)]
    df = spark.createDataFrame(docs, "id int, tokens array<string>")
    vocab = E.vocabulary(df).filter("token <> 'new'")
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    out = sorted((str(r["id"]), r["input_ids"]) for r in E.encoded(df, vocab, "id").collect())
    want = [(str(i), [ids[t] for t in ts or [] if t in ids]) for i, ts in docs]
    assert out == sorted(want)


def test_encoding_looks_up_few_tokens_at_once(spark, monkeypatch):
    sizes = np.array([0, 2, 0, 3, 9, 1, 1, 4, 0])
    runs = list(E._runs(sizes, 5))
    assert runs == [(0, 4), (4, 1), (5, 2), (7, 2)]
    assert list(E._runs(sizes[:0], 5)) == []
    rows = [(i, [f"t{(i * j) % 40}" for j in range(n)] if n != 1 else None) for i, n in enumerate(sizes.tolist() * 30)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1)
    vocab = E.vocabulary(df).localCheckpoint()
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    monkeypatch.setattr(E, "LOOKED_UP", 5)
    monkeypatch.setattr(E, "HOT_TOKENS", 7)
    before = spark.conf.get(session.BATCH_SIZE)
    out = {r["id"]: r["input_ids"] for r in E.encoded(df, vocab, "id").collect()}
    assert spark.conf.get(session.BATCH_SIZE) == before
    assert {i: out[i] or [] for i, _ in rows} == {i: [ids[t] for t in tokens or []] for i, tokens in rows}


def test_splits_with_null_keys(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    for fraction, held in ((0.1, 10), (0.45, 45), (0.9, 50), (0.0, 0)):
        out = E.exact_split(df, "k", fraction).filter("split = 'validation'").collect()
        assert len(out) == held and all(r["k"] is not None for r in out)
    assert E.hash_split(df, "k").filter("split = 'validation' AND k IS NULL").count() == 0
    none = spark.createDataFrame([(None,)] * 3, "k long")
    assert [r["split"] for r in E.exact_split(none, "k").collect()] == ["train"] * 3
    assert E.exact_split(none.limit(0), "k").collect() == []


def test_padded_batches(spark):
    rows = [(1, 1, [5, 6], [1, 1], [5, 6], None), (2, 1, [7], [1], None, 3), (3, 2, [8], [1], [8], 4)]
    schema = "id int, b int, input_ids array<int>, attention_mask array<int>, labels array<int>, cls_labels int"
    out = {r["id"]: r for r in E.padded_batches(spark.createDataFrame(rows, schema), "b").collect()}
    assert out[2]["input_ids"] == [7, 0] and out[2]["attention_mask"] == [1, 0]
    assert out[2]["labels"] == [-100, -100] and out[1]["cls_labels"] == -100
    assert out[3]["input_ids"] == [8]


def test_splits_are_disjoint_complete_and_repeatable(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    for split in (E.hash_split, E.exact_split):
        first = {r["k"]: r["split"] for r in split(df, "k").collect()}
        again = {r["k"]: r["split"] for r in split(df.repartition(7), "k").collect()}
        assert first == again and set(first) == set(range(1001))
    held = sum(s == "validation" for s in first.values())
    assert held == 101
    loose = E.hash_split(df, "k").filter("split = 'validation'").count()
    assert 70 < loose < 135


def test_tagged_prompts_and_tag_arrays(spark):
    pairs = spark.createDataFrame([(1, "yes"), (2, "no")], "id int, complete string")
    tags = [
        (1, 1, "big", "ADJ", ""), (1, 0, "Acme", "PROPN", "ORG"), (1, 2, "red", "ADJ", "GPE"),
        (1, 3, "x", "SYM", None),
    ]
    notes = spark.createDataFrame(tags, "id int, pos int, token string, pos_tag string, ent string")
    text = {r["id"]: (r["text"], r["prompt_tokens"]) for r in E.tagged_prompts(pairs, notes, "id").collect()}
    assert text == {1: ("Acme_ORG big_ADJ red_GPE x yes <end>", 4), 2: (" no <end>", 0)}
    arrays = {r["id"]: r for r in E.tag_arrays(pairs, notes, "id", length=23).collect()}
    assert arrays[1]["pos_ids"] == [0] * 20 + [8, 1, 1]
    assert arrays[1]["ner_ids"] == [0] * 20 + [2, 7, 3]
    assert arrays[2]["pos_ids"] == [0] * 23
    (long,) = E.tag_arrays(pairs.filter("id = 1"), notes, "id", length=30).collect()
    assert long["ner_ids"] == [0] * 20 + [2, 7, 3, 7] + [0] * 6


def test_align_left(values):
    rows = [([1, 2], 4), ([1, 2, 3], 2), ([], 1), ([1], 1)]
    out = values(lambda a, n: X.align_left(a, n, F.lit(0)), rows, "a array<int>, n int")
    assert out == [[0, 0, 1, 2], [2, 3], [0], [1]]
    assert K.HEAD_LENGTH + K.TAIL_LENGTH == K.WINDOW_LENGTH
