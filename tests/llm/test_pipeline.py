import random
import re

import corpus_pipeline
from edges import EDGES

from adfacts.llm import CHECKS, QUERIES, contamination, mixing, near_copies, quality, secret_scan
from adfacts.llm.common import written

from test_contamination import text_of
from test_near_copies import edited

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def raw():
    """Documents that each stage has something to do with, and who they are."""
    rng = random.Random(21)
    items = [(i, text_of(rng, 30, 500)) for i in range(4)]
    docs, who = list(EDGES), {}
    for i in range(100, 400):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(60, 150))]
        kind = ("clean", "clean", "clean", "leak", "secret", "copy", "junk")[i % 7]
        if kind == "leak":
            words[5:5] = items[i % 4][1].split()
        if kind == "secret":
            words[3:3] = ["password:", "hunter2hunter2"]
        if kind == "copy":
            words = edited(rng, docs[-1][1].split(), 1) if who.get(i - 3) else words
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words)
        docs.append((i, text, "en", "hot" if i % 3 else "rare", len(text)))
        who[i] = kind
    labels = [(i, int(k != "junk"), 0) for i, k in who.items() if i % 2]
    return docs, items, labels, who


def test_stages_one_after_the_other(spark, folder):
    docs, items, labels, who = raw()
    path = folder(documents=docs, benchmark=items, labels=labels)
    now = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, written(stage(spark, now, path), name)
        left[name] = [tuple(r) for r in now.select("doc_id", "text").collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == COLUMNS
        held = {(r["doc_id"], r["text"]) for r in before.collect()}
        if name in ("quality", "near_copies", "contamination"):
            assert set(left[name]) <= held
    by_stage = {name: {i for i, _ in rows} for name, rows in left.items()}
    clean = {i for i, k in who.items() if k == "clean"}
    assert clean <= by_stage["quality"]
    junk = {i for i, k in who.items() if k == "junk"}
    assert len(junk & by_stage["quality"]) <= len(junk) // 20
    leaks = {i for i, k in who.items() if k == "leak"}
    assert leaks & by_stage["near_copies"] and not leaks & by_stage["contamination"]
    assert len([i for i, _ in left["near_copies"] if i in (9, 10)]) == 1
    assert not any("hunter2" in (t or "") for _, t in left["secrets"])
    assert by_stage["secrets"] == by_stage["contamination"]
    assert by_stage["mixture"] <= by_stage["secrets"]
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*COLUMNS, "copy", "shuffle_key"]
    assert sorted(map(str, out.select("doc_id", "copy").collect())) == sorted(
        map(str, now.select("doc_id", "copy").collect())
    )


def test_stages_do_what_their_operators_say(spark, folder):
    docs, items, labels, _ = raw()
    path = folder(documents=docs, benchmark=items, labels=labels)
    table = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return sorted(map(str, (r["doc_id"] for r in df.select("doc_id").collect())))

    for name, query, keep in (
        ("quality", quality.QUERIES["op5_quality"], "keep"),
        ("contamination", contamination.QUERIES["op1_contamination"], "not contaminated"),
    ):
        assert ids(stages[name](spark, table, path)) == ids(query(spark, path).filter(keep))
    kept = stages["near_copies"](spark, table, path)
    classes = near_copies.QUERIES["op4_near_copies"](spark, path)
    assert kept.count() == classes.select("class_id").distinct().count() + 1  # 7 and 7 are two texts
    found = secret_scan.with_spans(stages["secrets"](spark, table, path), "doc_id")
    assert found.filter("size(spans) > 0").count() == 0
    assert ids(stages["mixture"](spark, table, path)) == ids(mixing.QUERIES["op2_mixed_sources"](spark, path))


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder()).collect() == []


def test_one_query_per_operator():
    import __spark_entry__

    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(CHECKS) <= set(__spark_entry__.oracle_sql())
