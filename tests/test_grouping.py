import random

from pyspark.sql import functions as F

from adfacts.operators import grouping as G


def hot_rows(n=3000, seed=7):
    """Rows of which one group holds two thirds, another only one."""
    random.seed(seed)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, random.randrange(50)) for i in range(n)]
    return [*rows, ("lonely", n, 5), (None, n + 1, 6), (None, n + 2, 7)]


def test_running_totals_match_a_plain_scan(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, id long, x long")
    order = [F.col("x").desc(), F.col("id")]
    out = G.running_totals(df, ["g"], order, {"before": F.col("x"), "place": F.lit(1)}).collect()
    assert len(out) == len(rows)
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for place, (_, i, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))):
            want[i] = (total if place else None, place if place else None)
            total += x
    got = {r["id"]: (r["before"] or None, r["place"] or None) for r in out}
    assert got == {i: (t or None, p) for i, (t, p) in want.items()}


def test_running_totals_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    out = G.running_totals(df, [], [F.col("k")], {"place": F.lit(1)}).orderBy("k").collect()
    assert [r["place"] or 0 for r in out] == list(range(1000))


def test_a_hot_group_is_cut_into_slices(spark, monkeypatch):
    seen = []

    def spy(df):
        kept = df.cache()
        seen.append(kept)
        return kept

    monkeypatch.setattr(G, "pinned", spy)
    df = spark.createDataFrame(hot_rows(), "g string, id long, x long")
    G.running_totals(df, ["g"], [F.col("x"), F.col("id")], {"t": F.lit(1)}).count()
    slices = seen[0].filter("g = 'hot'").groupBy("_slice").count().collect()
    assert len(slices) > 3
    assert max(r["count"] for r in slices) < 1500


def test_spread_join_keeps_rows_and_spreads_a_hot_key(spark):
    df = spark.createDataFrame(hot_rows(), "g string, id long, x long")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    inner = G.spread_join(df, sizes, ["g"], ["id"])
    assert inner.count() == df.count()
    assert inner.filter("g is null").select("n").distinct().collect()[0]["n"] == 2
    assert inner.filter("g = 'hot'").select("n").distinct().collect()[0]["n"] == 2000
    left = G.spread_join(df, sizes.filter("g = 'hot'"), ["g"], ["id"], "left")
    assert left.count() == df.count()
    assert "n" in left.columns and "_salt" not in left.columns


def test_group_join_treats_nulls_alike_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "g string, id long, x long")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    small = G.group_join(df, F.broadcast(sizes), ["g"], "left")
    large = G.group_join(df, sizes.hint("merge"), ["g"], "left")
    spread = G.spread_join(df, sizes, ["g"], ["id"], "left")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert small.columns == large.columns == spread.columns == ["g", "id", "x", "n"]
    rows = sorted(map(str, small.collect()))
    assert rows == sorted(map(str, large.collect())) == sorted(map(str, spread.collect()))
    assert small.filter("g is null").select("n").distinct().collect()[0]["n"] == 2


def test_only_hot_keys_are_copied(spark, monkeypatch):
    monkeypatch.setattr(G, "SHARES", 10)
    df = spark.createDataFrame(hot_rows(), "g string, id long, x long")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = G.spread_join(df, sizes, ["g"], ["id"])
    assert out.count() == df.count()
    assert out.filter("g = 'hot'").select("n").distinct().collect()[0]["n"] == 2000
