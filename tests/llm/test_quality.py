import math
import random
from collections import defaultdict

import numpy as np
import pytest
from edges import EDGES

from adfacts.llm import quality as Q

NAME = "op5_quality"
KNOWN = "and the of a in with from to this that river house green walk morning paper quiet stone letter".split()


def clean(rng):
    lines = [" ".join(rng.choices(KNOWN, k=rng.randrange(4, 30))).capitalize() + "." for _ in range(rng.randrange(1, 8))]
    return "\n".join(lines)


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return clean(rng).upper().replace(" ", "!! ")
    if kind == 1:
        return " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in clean(rng).split())
    return " ".join(w for w in rng.choices(KNOWN, k=6) for _ in range(15))


def toxic(rng):
    found = clean(rng).split(" ")
    for _ in range(3):
        found.insert(rng.randrange(len(found)), rng.choice(["grumblor", "snarlkin", "grumblix"]))
    return " ".join(found)


def corpus(n=900):
    rng = random.Random(3)
    docs, labels, kinds = list(EDGES), [], {}
    for i in range(100, 100 + n):
        kind = rng.choices(["clean", "junk", "toxic"], [8, 2, 1])[0]
        text = {"clean": clean, "junk": junk, "toxic": toxic}[kind](rng)
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        docs.append((i, text, rng.choice(["en", "de"]), source, len(text)))
        kinds[i] = kind
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    labels += [(None, 1, 0), (5, None, None), (99_999, 0, 1), labels[0]]
    return docs, labels, kinds


def test_unlabelled_documents_are_told_apart(spark, folder):
    docs, labels, kinds = corpus()
    out = Q.QUERIES[NAME](spark, folder(documents=docs, labels=labels)).collect()
    assert len(out) == len(docs)
    seen = {r[0] for r in labels}
    right = defaultdict(list)
    for r in out:
        if r["doc_id"] in kinds and r["doc_id"] not in seen:
            right[kinds[r["doc_id"]]].append(r["keep"] == (kinds[r["doc_id"]] == "clean"))
            assert r["keep"] == (r["p_quality"] >= 0.5 and r["p_toxic"] <= 0.5)
    assert {k: sum(v) / len(v) > 0.95 for k, v in right.items()} == dict.fromkeys(["clean", "junk", "toxic"], True)


def test_the_stage_keeps_the_others(spark, folder):
    docs, labels, kinds = corpus(300)
    path = folder(documents=docs, labels=labels)
    table = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as host", "2 as n", "3 as _key")
    kept = Q.accepted(table, spark.read.parquet(f"{path}/labels.parquet"))
    assert kept.columns == table.columns
    want = [r["doc_id"] for r in Q.QUERIES[NAME](spark, path).filter("keep").collect()]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())


def test_sparse_paths_shrink_like_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for host, share, paths in (("a", 0.1, 3), ("b", 0.6, 4), (None, 0.3, 1), ("d", 0.9, 1)):
        for path in range(paths):
            for _ in range(rng.choice([1, 5, 60])):
                low = min(max(rng.gauss(share, 0.1), 0.0), 1.0)
                rows.append((host, f"p{path}" if path else None, low, rng.random() / 4))
    own = spark.createDataFrame(rows, "host string, path string, low double, toxic double")
    got = {(r["host"], r["path"]): r for r in Q.shrunk(own).collect()}
    assert len(got) == len({r[:2] for r in rows})
    for at, kind in ((2, "low"), (3, "toxic")):
        groups = {key: defaultdict(list) for key in (1, 2)}
        for r in rows:
            groups[1][r[:1]].append(r[at])
            groups[2][r[:2]].append(r[at])
        mean = sum(r[at] for r in rows) / len(rows)

        def strength(values):
            n = len(rows)
            spread = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in values.values()) / n
            between = max(spread - mean * (1 - mean) * len(values) / n, 1e-9)
            return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)

        of_host, of_path = strength(groups[1]), strength(groups[2])
        for (host, path), values in groups[2].items():
            on_host = groups[1][(host,)]
            posterior = (sum(on_host) + of_host * mean) / (len(on_host) + of_host)
            share = (sum(values) + of_path * posterior) / (len(values) + of_path)
            want = math.log(share / (1 - share)) - math.log(mean / (1 - mean))
            assert got[host, path][kind] == pytest.approx(want)


def test_more_paths_than_are_broadcast_change_nothing(spark, folder, monkeypatch):
    docs, labels, _ = corpus(200)
    path = folder(documents=docs, labels=labels)
    want = sorted(map(str, Q.QUERIES[NAME](spark, path).select("doc_id", "keep").collect()))
    monkeypatch.setattr("adfacts.llm.common.BROADCAST_ROWS", 1)
    assert sorted(map(str, Q.QUERIES[NAME](spark, path).select("doc_id", "keep").collect())) == want


def test_the_sample_is_bounded(spark, folder):
    docs, labels, _ = corpus(200)
    path = folder(documents=docs, labels=labels)
    rows = Q.labelled_sample(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")), sample=37)
    assert rows.count() <= 37 and rows.columns == ["text", "low", "toxic"]


def test_newton_finds_the_best_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.5)))).astype(float)
    weights = Q.fitted(x, y)

    def loss(w):
        odds = x @ w[:-1] + w[-1]
        return (np.logaddexp(0, odds) - y * odds).sum() + 0.5 * (w[:-1] ** 2).sum() + 0.5e-6 * w[-1] ** 2

    for step in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3:
        assert loss(weights) <= loss(weights + step)
    assert not Q.fitted(x, np.zeros(500)).any()


def test_without_labels_nothing_is_rejected(spark, folder):
    out = Q.QUERIES[NAME](spark, folder(documents=EDGES)).collect()
    assert len(out) == len(EDGES) and all(r["keep"] for r in out)
    one = Q.QUERIES[NAME](spark, folder(documents=EDGES, labels=[(5, 1, 0), (6, 1, 0)])).collect()
    assert all(r["keep"] for r in one)
    assert Q.QUERIES[NAME](spark, folder()).collect() == []
    assert Q.QUERIES[NAME](spark, folder(labels=[(1, 0, 1)])).collect() == []


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert Q.labelled_sample(docs, labels, sample=20).count() == 21
