"""Operators over ordered slices, intervals, versions and states, against plain loops."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adfacts.operators import evaluate as E
from adfacts.operators.asof import as_of
from adfacts.operators.gaps import without_gaps
from adfacts.operators.intervals import cover, overlaps
from adfacts.operators.sessions import session_summary, with_sessions
from adfacts.operators.slices import sliced
from adfacts.operators import intervals, similar
from adfacts.operators.states import States, quartiles_of, report_of
from adfacts.operators.versions import difference


def hot(rng, n):
    """Keys of which one has a third of all rows, some are null."""
    return [rng.choice(["hot", f"k{rng.randrange(30)}", f"k{rng.randrange(30)}"]) if rng.random() < 0.97 else None for _ in range(n)]


def test_as_of_like_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(i, k, None if i % 40 == 3 else rng.randrange(300)) for i, k in enumerate(hot(rng, 900))]
    values = [(k, None if i % 50 == 4 else rng.randrange(300), rng.choice("abc"), None if i % 9 == 1 else i) for i, k in enumerate(hot(rng, 400))]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    known = spark.createDataFrame(values, "key string, since long, label string, n long")
    out = as_of(df, known, "key", "at", "since", ["label", "n"])
    assert out.columns == ["id", "key", "at", "since", "label", "n"]

    def want(i, k, at):
        if k is None or at is None:
            return (i, k, at, None, None, None)
        found = [v for v in values if v[0] == k and v[1] is not None and v[1] <= at]
        best = max(found, key=lambda v: (v[1], v[2], v[3] is not None, v[3] or 0), default=(None,) * 4)
        return (i, k, at, best[1], best[2], best[3])

    assert sorted(map(tuple, out.collect())) == sorted(want(*r) for r in rows)


def test_a_hot_key_is_in_many_tasks(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    parts = sliced(df, ["key"], ["at"]).filter("key = 'hot'").groupBy("_slice").count().collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < 700


def test_no_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 5)], "id long, key string, at long")
    known = spark.createDataFrame([], "key string, since long, label string")
    assert [tuple(r) for r in as_of(df, known, "key", "at", "since", ["label"]).collect()] == [(1, "a", 5, None, None)]
    assert as_of(df.limit(0), known, "key", "at", "since", ["label"]).collect() == []


def test_sessions_like_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(i, k, None if i % 70 == 5 else rng.randrange(4000)) for i, k in enumerate(hot(rng, 1200))]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    got = {r["id"]: r["session"] for r in with_sessions(df, "key", "at", 20, "id").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        last, n = None, 0
        for i, _, at in sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0])):
            n += last is None or at - last > 20
            last = at
            want[i] = n
    assert got == want and max(want.values()) > 20
    summed = session_summary(df, "key", "at", 20, "id").collect()
    sizes = Counter((r[1], want[r[0]]) for r in rows if r[0] in want)
    assert {(r["key"], r["session"]): r["events"] for r in summed} == sizes


def test_gaps_like_a_plain_loop(spark):
    rng = random.Random(3)
    rows = {}
    for key in hot(rng, 500):
        rows[key, rng.randrange(200) if key != "hot" else rng.randrange(2000)] = rng.choice([None, rng.random(), 1.0, 2.0])
    rows["wide", 0], rows["wide", 9000] = 0.0, 9.0
    rows["unknown", 3], rows["unknown", 6] = None, None
    df = spark.createDataFrame([(k, s, v) for (k, s), v in rows.items()] + [("x", None, 1.0)], "key string, step long, v double")
    got = {(r["key"], r["step"]): tuple(r)[2:] for r in without_gaps(df, "key", "step", "v").collect()}
    want = {}
    for key in {k for k, _ in rows}:
        steps = sorted(s for k, s in rows if k == key)
        known = [s for s in steps if rows[key, s] is not None]
        for s in range(steps[0], steps[-1] + 1):
            before = max((x for x in known if x <= s), default=None)
            behind = min((x for x in known if x >= s), default=None)
            a, b = rows.get((key, before)), rows.get((key, behind))
            line = None
            if a is not None and b is not None:
                line = a if before == behind else a + (b - a) * (s - before) / (behind - before)
            want[key, s] = ((key, s) in rows, a, b, line)
    assert got.keys() == want.keys()
    for at, values in got.items():
        assert values[:3] == want[at][:3] and values[3] == pytest.approx(want[at][3]), at


def test_overlaps_like_a_theta_join(spark):
    rng = random.Random(4)

    def some(n, wide):
        out = []
        for i in range(n):
            low = rng.randrange(-500, 500)
            high = low + rng.choice([0, 1, rng.randrange(wide), rng.randrange(wide), -1])
            out.append((i, rng.choice(["a", "b", None]), low if rng.random() < 0.97 else None, high))
        return out

    a, b = some(200, 40), some(150, 900)
    left, right = (spark.createDataFrame(x, "id long, k string, f long, t long") for x in (a, b))

    def pairs(keyed):
        return sorted(
            (x[0], y[0]) for x in a for y in b
            if x[2] is not None and y[2] is not None and x[2] <= x[3] and y[2] <= y[3]
            and x[2] <= y[3] and y[2] <= x[3] and (not keyed or (x[1] is not None and x[1] == y[1]))
        )

    for keys in (None, ["k"]):
        found = overlaps(left, right, ("f", "t"), ("f", "t"), keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian", plan)
        assert sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect()) == pairs(keys)
    assert overlaps(left.limit(0), right, ("f", "t"), ("f", "t")).collect() == []


def test_nodes_of_many_intervals_are_not_broadcast(spark, monkeypatch):
    # Small for a table of intervals; each is several nodes, which Spark's estimate leaves out.
    many = spark.range(400_000).select("id", F.col("id").alias("f"), (F.col("id") + 99).alias("t"))

    def plan_of(left, right):
        return overlaps(left, right, ("f", "t"), ("f", "t"))._jdf.queryExecution().executedPlan().toString()

    assert "Broadcast" not in plan_of(many, many)
    assert plan_of(many, many.limit(10)).count("BroadcastHashJoin") == 2
    monkeypatch.setattr(intervals, "SENT_NODES", 0)
    test_overlaps_like_a_theta_join(spark)


def test_rows_of_two_large_tables_are_shuffled_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SENT_NODES", 0)
    many = spark.range(6000).select("id", (F.col("id") * 37 % 50000).alias("f"))
    left = many.withColumn("t", F.col("f") + F.col("id") % 40)
    right = many.withColumn("t", F.col("f") + F.when(F.col("id") % 100 == 3, 5000).otherwise(F.col("id") % 50))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = overlaps(left, right, ("f", "t"), ("f", "t"))
        plan = found._jdf.queryExecution().executedPlan()
        got = sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    a, b = ([tuple(r) for r in df.select("f", "t").collect()] for df in (left, right))
    assert got == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[1] and y[0] <= x[1]]

    def shuffled(node):
        own = node.metrics().get("shuffleRecordsWritten").get().value() if "ShuffleExchange" in node.getClass().getName() else 0
        return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))

    # Nodes of a tree are 12.6 times the rows.
    assert 12_000 < shuffled(plan) <= 3 * 12_000


def test_overlaps_of_very_unlike_widths(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SENT_NODES", 0)
    used = []
    monkeypatch.setattr(intervals, "grids", lambda *a, grids=intervals.grids: used.append(grids(*a)) or used[-1])
    rng = random.Random(8)

    def some(n, widths):
        lows = [rng.choice([rng.randrange(-3000, 3000), rng.randrange(-(2**20), 2**20)]) for _ in range(n)]
        out = [(i, rng.choice("ab"), low, low + rng.choice(widths)) for i, low in enumerate(lows)]
        # Of an unknown end, or all there is; and far away.
        return out + [(n, "a", 5, 2**62), (n + 1, "a", -(2**62), 2**61), (n + 2, "b", 2**60, 2**60 + 7), (n + 3, "b", 5, None)]

    a, b = some(300, [0, 1, 3, 40, 5000]), some(260, [0, 9, 60, 60, 2**14, 2**19])
    left, right = (spark.createDataFrame(x, "id long, k string, f long, t long") for x in (a, b))
    for one, two, x, y in ((left, right, a, b), (right, left, b, a)):
        for keys in (None, ["k"]):
            want = sorted(
                (p[0], q[0]) for p in x for q in y
                if p[3] is not None and q[3] is not None and p[2] <= q[3] and q[2] <= p[3] and (not keys or p[1] == q[1])
            )
            found = overlaps(one, two, ("f", "t"), ("f", "t"), keys)
            assert found.columns == ["left", "right"] and found.select("left.*").columns == ["id", "k", "f", "t"]
            assert sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect()) == want and want
    assert all(len(g) > 1 for g in used)


def test_grids_fit_most_rows():
    def of(size, n, lowest=0, highest=10**6):
        return {"size": size, "n": n, "total": n * 2.0**size, "lowest": lowest, "highest": highest}

    narrow = [of(3, 1000), of(5, 9000)]
    assert intervals.grids([narrow, narrow], 1) == [5]
    # One row without an end is on a grid of its own.
    fine, coarse = intervals.grids([narrow, narrow + [of(62, 1)]], 1)
    assert fine == 5 and 2 ** (62 - coarse) <= intervals.MOST_COPIES
    # Wide rows that are few, or not much wider, stay where the others are.
    assert intervals.grids([narrow, narrow + [of(13, 20)]], 1) == [6]
    # Many wide rows do not make the cells of narrow ones wide.
    mixed = [of(0, 9000), of(20, 1000)]
    assert intervals.grids([mixed, mixed], 1) == [3, 20]
    # Smaller cells give more tasks, but not at the price of many copies.
    wide = [of(17, 500)]
    assert intervals.grids([wide, wide], 1) == [18]
    assert intervals.grids([wide, wide], 4) == [17]
    assert intervals.grids([wide, wide], 10**4) == [16]
    for sides in ([narrow, mixed], [[of(i, 100) for i in range(16)], narrow], [wide, mixed + narrow]):
        assert intervals._copies(sides, intervals.grids(sides, 10**5)) <= (False, 4 * sum(r["n"] for s in sides for r in s))


def test_narrow_rows_beside_wide_ones_are_not_all_tried(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SENT_NODES", 0)
    cells = []
    monkeypatch.setattr(intervals, "_in_cells", lambda *a, f=intervals._in_cells: cells.append(f(*a)) or cells[-1])

    def tried():
        left, right = (df.groupBy(f"_{s}_grid", f"_{s}_cell").agg(F.count("*").alias(f"_{s}")) for s, df in zip("lr", cells[-2:]))
        both = left.join(right, (left["_l_grid"] == right["_r_grid"]) & (left["_l_cell"] == right["_r_cell"]))
        return both.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0]

    # Of each side one row has no end, so all rows of the other are in its cell.
    rows = spark.range(20_000).select("id", (F.col("id") * 10).alias("f"))
    rows = rows.withColumn("t", F.when(F.col("id") == 19_990, 2**62).otherwise(F.col("f") + 2))
    found = overlaps(rows, rows.withColumn("f", F.col("f") + 1), ("f", "t"), ("f", "t"))
    assert found.count() == 20_000 + 2 * 9
    assert tried() < 10 * 20_000
    # Wide intervals apart, narrow ones close together.
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 9 == 0, F.col("id") * 3 + 10**7).otherwise(F.col("id") * 3).alias("f"))
    rows = rows.withColumn("t", F.col("f") + F.when(F.col("id") % 9 == 0, 30_000).otherwise(1))
    right = rows.filter("id % 9 <> 0")
    assert overlaps(rows, right, ("f", "t"), ("f", "t")).count() == right.count()
    assert tried() < 10 * 20_000


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_covers_are_exact_and_disjoint(spark, levels):
    most = 8**levels - 1
    rng = random.Random(levels)
    rows = [(low, min(low + rng.randrange(most), low + most - 1)) for low in (rng.randrange(3000) for _ in range(100))]
    df = spark.createDataFrame(rows, "f long, t long")
    for r in df.select("f", "t", cover(F.col("f"), F.col("t"), levels).alias("c")).collect():
        numbers = [n for c in r["c"] for n in range(c["node"] << 3 * c["level"], (c["node"] + 1) << 3 * c["level"])]
        assert sorted(numbers) == list(range(r["f"], r["t"] + 1))
        assert len(r["c"]) <= 14 * levels + 8


def test_differences_have_multiplicity(spark):
    rng = random.Random(5)
    old = [(rng.randrange(400) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), float(rng.randrange(3))) for _ in range(1500)]
    new = [r for r in old if rng.random() > 0.01]
    new += [(r[0], "new", r[2]) for r in rng.sample(old, 8)] + rng.sample(old, 5) + [(999, "x", 0.0)] * 3
    schema = "k long, v string, w double"
    out = difference(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).select("w", "k", "v"), ["k"])
    gone, come = Counter(old) - Counter(new), Counter(new) - Counter(old)
    both = {r[0] for r in gone} & {r[0] for r in come}
    want = [(*r, "changed_from" if r[0] in both else "removed", n) for r, n in gone.items()]
    want += [(*r, "changed_to" if r[0] in both else "added", n) for r, n in come.items()]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_equal_versions_and_empty_ones(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(300)], "k long, v string")
    assert difference(df, df.repartition(3), ["k"]).collect() == []
    assert difference(df.limit(0), df.limit(0), ["k"]).collect() == []
    out = difference(df.limit(0), df, ["k"])
    assert out.count() == 300 and {r["change"] for r in out.collect()} == {"added"}


def test_rows_of_equal_buckets_are_not_shuffled(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    other = df.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    out = difference(df, other, ["k"])
    assert sorted((r["k"], r["v"], r["change"]) for r in out.collect()) == [(77, -1, "changed_to"), (77, 0, "changed_from")]
    from adfacts.operators import versions as V

    opened, bits = V.differing(V._hashed(df, ["k"]), V._hashed(other, ["k"]))
    assert opened.count() == 1 and bits >= 10


def results(spark, rng, n):
    tasks = ["[TASK: Salary] x", "[TASK: Seniority] x", "[TASK: Work Arrangement] x", "none", None]
    salaries = ["100-900-AUD-MONTHLY", "100-800-AUD-MONTHLY", "0-0-None-None", "text", None]
    rows = [
        (rng.choice(["m1", "m2", None]), rng.choice(tasks), rng.choice(salaries), rng.choice(salaries), rng.choice([None, rng.randrange(9) / 8]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "model string, prompt string, complete string, y_pred string, inference_time double")


def shown(df, columns):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()), key=str
    )


def test_reports_of_states_after_add_replace_and_delete(spark, tmp_path):
    rng = random.Random(6)
    a, b, c, d = (results(spark, rng, n) for n in (120, 80, 1, 60))
    states = States(spark, str(tmp_path / "states"))
    assert report_of(states.read()).collect() == []
    states.put("a b/ü.json", a)
    states.put("b", b)
    states.put("c", c)
    states.put("b", d)
    states.delete("c")
    every = a.unionByName(d)
    want = E.report(every)
    assert shown(report_of(states.read()), want.columns) == shown(want, want.columns)
    got = {r["model"]: tuple(r)[1:] for r in quartiles_of(states.read()).collect()}
    for r in every.groupBy("model").agg(F.count("inference_time"), *[F.percentile("inference_time", F.lit(q)) for q in (0.25, 0.5, 0.75)]).collect():
        assert got[r[0]] == pytest.approx(tuple(r)[1:])
    states.delete("never there")
    states.delete("a b/ü.json")
    assert shown(report_of(states.read()), want.columns) == shown(E.report(d), want.columns)


def test_grouped_scores_are_those_of_separate_reports(spark, tmp_path):
    results(spark, random.Random(7), 300).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    out = E.grouped_scores(df, [["model", "task_type"], ["model"], ["task_type"], []])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["level"], r["model"], r["task_type"]): tuple(r)[3:] for r in out.collect()}
    rows = E.marked(df)
    want = {}
    for keys in (["model", "task_type"], ["model"], ["task_type"], []):
        macro = {tuple(r[k] for k in keys): r for r in E.macro_scores(rows, keys).collect()}
        for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("val").cast("int")).alias("a")).collect():
            m = macro.get(tuple(r[k] for k in keys))
            at = (",".join(keys), r["model"] if "model" in keys else None, r["task_type"] if "task_type" in keys else None)
            want[at] = (r["n"], r["a"], m and m["macro_recall"], m and m["macro_f1"])
    assert got.keys() == want.keys()
    for at in got:
        assert got[at] == pytest.approx(want[at]), at


@pytest.mark.parametrize("least", [-0.5, 0.2, 0.7, 0.999])
def test_cosines_above_a_threshold_like_all_pairs(spark, monkeypatch, least):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) * (4 if d < 2 else 1) for d in range(7)]) for i in range(60)]
    rows += [(60, [0.0] * 7), (61, None), (62, []), (63, [1.0, None] + [0.0] * 5), (64, rows[3][1]), (65, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    labels = spark.createDataFrame([(f"l{i}", v) for i, v in rows[20:]], "label string, w array<double>")

    def cosine(a, b):
        if not a or not b or None in a or None in b or not any(a) or not any(b):
            return -2.0
        return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    want = {(i, f"l{j}"): cosine(a, b) for i, a in rows for j, b in rows[20:] if cosine(a, b) > least}
    for block, cells in ((4096, 1 << 22), (7, 20)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "CELLS", cells)
        out = similar.cosine_pairs(df, "id", "v", labels, "label", "w", least)
        assert out.columns == ["id", "label", "cosine"]
        got = {(r["id"], r["label"]): r["cosine"] for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("least", [0.4, 0.95])
def test_a_block_of_cosines_takes_little_memory(least):
    rng = np.random.default_rng(3)
    vectors, labels = (rng.normal(size=(n, 64)) for n in (1024, 4096))
    vectors, labels = (m / np.linalg.norm(m, axis=1)[:, None] for m in (vectors, labels))
    labels[:5] = vectors[:5]
    step = max(similar.CELLS // len(labels), 1)
    tracemalloc.start()
    row, label, cosine = similar._close(vectors[:step], labels, 16, least)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = vectors[:step] @ labels.T
    assert list(zip(row, label)) == list(zip(*np.nonzero(every > least)))
    assert cosine == pytest.approx(every[row, label])
    assert peak < 100 * 1024**2
