import random

import pytest

from adfacts.llm import contamination as C

from edges import EDGES

NAME = "op1_contamination"


def text_of(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def planted():
    rng = random.Random(5)
    items = [(i, text_of(rng, rng.choice([4, 10, 12, 30]), 400)) for i in range(12)]
    items += [(12, None), (13, ""), (14, "..."), (15, items[0][1]), (None, "only this short one")]
    docs = list(EDGES)
    for i in range(100, 160):
        words = text_of(rng, rng.randrange(3, 200), 400).split()
        item = (rng.choice(items)[1] or "").split()
        at = rng.randrange(len(words))
        if i % 3 == 0:
            words[at:at] = item
        elif i % 3 == 1 and len(item) > 3:
            item[rng.randrange(len(item))] = "changed"
            item.insert(rng.randrange(len(item)), "more")
            words[at:at] = item
        sep = rng.choice([" ", ", ", "\n"])
        docs.append((i, sep.join(words).upper() if i % 2 else sep.join(words), "en", "s", 1))
    docs += [(200, "ONLY this, short one", "en", "s", 1), (201, (items[3][1] + " ") * 3, "en", "s", 1)]
    return docs, items


def test_matches_sql_on_planted_passages_and_edges(folder, matches):
    docs, items = planted()
    rows = matches(C, NAME, folder(documents=docs, benchmark=items))
    assert len(rows) == len(docs)
    assert sum(r[0] for r in rows) >= 15  # contaminated comes first by name


def test_small_shards_and_blocks_change_nothing(spark, folder, monkeypatch):
    docs, items = planted()
    path = folder(documents=docs, benchmark=items)
    read = spark.read.parquet
    one = C.search(C.positional_index(read(f"{path}/documents.parquet")), read(f"{path}/benchmark.parquet"))
    index = C.positional_index(read(f"{path}/documents.parquet"), shard_words=300)
    assert index.select("shard").distinct().count() > 20
    many = C.search(index, read(f"{path}/benchmark.parquet"), block_windows=20)

    def shown(df):
        return sorted(
            (str(r["doc_id"]), r["n_words"], str(r["items"]), r["n_near"])
            for r in df.select("doc_id", "n_words", "items", "n_near").collect()
        )

    # Counts order the terms; whatever the order and the block, matches stay.
    assert shown(one) == shown(many)
    assert sum(r[3] for r in shown(one)) > 10
    hits = many.select("doc_id", C.hit_words("spans").alias("n")).collect()
    assert sorted((str(a), n) for a, n in hits) == sorted(
        (str(a), n) for a, n in one.select("doc_id", C.hit_words("spans").alias("n")).collect()
    )


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
NEAR = {
    1: ITEM, 2: ITEM.replace("delta", "delta so"), 3: ITEM.replace("beta", "x").replace("iota", "y"),
    4: ITEM.replace("beta", "x").replace("iota", "y").replace("eta", "z"), 5: "kappa " + ITEM[:20],
    6: "so on " + ITEM.replace("alpha", "x"), 7: ITEM.replace("theta iota", "iota theta"),
    8: ITEM.replace("kappa", ""), 9: f"{ITEM} {ITEM.replace('gamma', 'x')} {ITEM}",
    10: ITEM.replace("epsilon", "a b c"), 11: ITEM.replace("beta ", ""),
}


def test_proximity_allows_gaps_and_one_term_in_five(spark, folder, matches):
    # The last item has a word that no document has; so has item 2, twice.
    items = [(1, ITEM), (2, ITEM.replace("delta", "nowhere").replace("eta", "neither")),
             (3, ITEM.replace("beta", "nowhere"))]
    path = folder(documents=[(i, t, "en", "s", 1) for i, t in NEAR.items()], benchmark=items[:1])
    rows = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in C.QUERIES[NAME](spark, path).collect()}
    assert rows == {
        1: (10, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (0, 1), 7: (0, 1), 8: (0, 1),
        9: (20, 1), 10: (0, 1), 11: (0, 1),
    }
    matches(C, NAME, path)
    path = folder(documents=[(i, t, "en", "s", 1) for i, t in NEAR.items()], benchmark=items[2:])
    rows = {r["doc_id"]: r["n_near"] for r in C.QUERIES[NAME](spark, path).collect()}
    assert rows[1] == 1 and rows[2] == 1 and rows[3] == 1 and rows[5] == 0
    matches(C, NAME, folder(documents=[(i, t, "en", "s", 1) for i, t in NEAR.items()], benchmark=items))


def plain_near(doc, run, slack=C.SLACK):
    """Near matches of one window in one text, from every start."""
    found = []
    for s in range(-len(run) - slack, len(doc) + slack):
        misses = sum(
            t not in doc[max(s + q - slack, 0):max(s + q + slack + 1, 0)] for q, t in enumerate(run)
        )
        if misses <= len(run) // 5:
            found.append(s)
    n, last, exact = 0, None, False
    for s in [*found, None]:
        if last is not None and (s is None or s != last + 1):
            n += not exact
            exact = False
        if s is not None and s >= 0 and doc[s:s + len(run)] == run:
            exact = True
        last = s
    return n


def test_proximity_like_every_start_tried(spark, folder):
    rng = random.Random(9)
    docs = [(i, text_of(rng, rng.randrange(1, 60), 12), "en", "s", 1) for i in range(40)]
    items = [(i, text_of(rng, n, 12)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 10, 10, 13, 15])]
    rows = C.QUERIES[NAME](spark, folder(documents=docs, benchmark=items)).collect()
    runs = {run for _, t in items for run in C.item_windows(t.split())}
    want = {i: sum(plain_near(t.split(), list(run)) for run in runs) for i, t, *_ in docs}
    assert {r["doc_id"]: r["n_near"] for r in rows} == want and sum(want.values()) > 50


def test_empty_tables(spark, folder, matches):
    assert matches(C, NAME, folder()) == []
    assert matches(C, NAME, folder(benchmark=[(1, "a b c")])) == []
    rows = C.QUERIES[NAME](spark, folder(documents=EDGES)).collect()
    assert len(rows) == len(EDGES) and not any(r["contaminated"] for r in rows)


def test_the_stage_drops_only_contaminated_documents(spark, folder):
    docs, items = planted()
    path = folder(documents=docs, benchmark=items)
    bad = {(r["doc_id"]) for r in C.QUERIES[NAME](spark, path).collect() if r["contaminated"]}
    table = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as place", "2 as _key", "3 as items")
    kept = C.without_contaminated(table, spark.read.parquet(f"{path}/benchmark.parquet"))
    assert kept.columns == table.columns
    want = sorted(str(d) for d, *_ in docs if d not in bad)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_a_window_has_to_fit_into_the_gap(spark):
    with pytest.raises(ValueError, match="64"):
        C.search(None, None, window=63)
