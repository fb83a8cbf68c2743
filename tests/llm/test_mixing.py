import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adfacts.llm import mixing as M

from edges import EDGES

NAME = "op2_mixed_sources"


def many(n=3000):
    """One source with half of all rows, some small ones."""
    return [(i, "x" * (10 + i % 7), "en", "hot" if i % 2 else f"s{i % 9}", 10) for i in range(n)]


def test_matches_sql(folder, matches):
    assert matches(M, NAME, folder(documents=EDGES))
    assert matches(M, NAME, folder(documents=many()))
    assert matches(M, NAME, folder()) == []


def test_rates_reach_the_target_weights(spark):
    docs = spark.createDataFrame(many(), "doc_id long, text string, lang string, source string, n_chars long")
    targets = spark.createDataFrame([("hot", 1.0), ("s2", 2.0), ("s4", 1.0)], "source string, weight double")
    sizes = {r["source"]: r["size"] for r in M.source_sizes(docs).collect()}
    rates = {r["source"]: r["rate"] for r in M.repetition_rates(M.source_sizes(docs), targets).collect()}
    named = {s: sizes[s] for s in ("hot", "s2", "s4")}
    for source, weight in (("hot", 0.25), ("s2", 0.5), ("s4", 0.25)):
        assert rates[source] * sizes[source] == pytest.approx(weight * sum(named.values()))
    assert rates["s0"] == pytest.approx(1.0)
    out = M.mixed(docs, targets).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    for r in out:
        want = rates[r["source"]] * sizes[r["source"]]
        assert abs(r["n"] - want) < 5 * math.sqrt(want * 17 * max(rates[r["source"]], 1))


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.0, 31.9, 150.0])
def test_counts_are_poisson(spark, mean):
    rates = spark.createDataFrame([("s", mean)], "source string, rate double")
    ids = spark.range(4000).crossJoin(M.with_distribution(rates))
    counts = [r["n"] for r in ids.select(M.copies(F.col("id"), F.col("_draws"), F.col("_sums")).alias("n")).collect()]
    average = sum(counts) / len(counts)
    variance = sum((c - average) ** 2 for c in counts) / len(counts)
    assert average == pytest.approx(mean, abs=5 * math.sqrt(max(mean, 1e-9) / 4000))
    assert variance == pytest.approx(mean, rel=0.15, abs=0.01)
    if 0 < mean < 5:
        share = Counter(counts)[0] / 4000
        assert share == pytest.approx(math.exp(-mean), abs=0.03)


def test_copies_repeat_and_are_spread_over_partitions(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, rate int, _draws int"
    rows = [(*r, "c", 1, 2) for r in many(600)]
    docs = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    first, second = (M.mixed(docs).withColumn("p", F.spark_partition_id()).collect() for _ in range(2))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert first == second
    assert set(docs.columns) - {"copy"} < set(first[0].asDict())
    assert len({r["p"] for r in first if r["source"] == "hot"}) > 3
    by_part = {}
    for r in first:
        by_part.setdefault(r["p"], []).append(r["shuffle_key"])
    assert all(keys == sorted(keys) for keys in by_part.values())
    copies = Counter((r["doc_id"], r["copy"]) for r in first)
    assert set(copies.values()) == {1}
