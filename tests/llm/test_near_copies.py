import random
from collections import Counter

import numpy as np
import pytest
from edges import EDGES

from adfacts.llm import near_copies as N
from adfacts.llm.common import words


def runs(text):
    """Occurrence-labelled runs of five words, in order."""
    found = words((text or "").encode())
    seen, out = Counter(), []
    for i in range(max(len(found) - 4, 1) if found else 0):
        run = tuple(found[i:i + 5])
        out.append((run, seen[run]))
        seen[run] += 1
    return out


def common(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def alike(a, b):
    n = common(a, b)
    return n / (len(a) + len(b) - n) if a and b else 0.0


def text_of(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        if not out:
            break
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"y{rng.randrange(10**6)}")
    return out


def planted():
    """Families of copies with few to many edits, one of them large; some exact copies."""
    rng = random.Random(11)
    texts = []
    for size, members in [(30, 5), (60, 6), (120, 80), (300, 12), (900, 4), (6, 6), (12, 8)]:
        base = text_of(rng, size)
        texts += [base] * 2
        texts += [edited(rng, base, rng.randrange(1, max(size // 20, 2))) for _ in range(members)]
    texts += [text_of(rng, rng.randrange(1, 200)) for _ in range(60)]
    line = text_of(rng, 25)
    texts += [line + text_of(rng, 40) for _ in range(30)]
    shuffled = text_of(rng, 200)
    texts += [shuffled, shuffled[100:] + shuffled[:100]]
    rng.shuffle(texts)
    return [(1000 + i, ", ".join(t).title(), "en", "s", 1) for i, t in enumerate(texts)]


def brute(docs):
    """Classes of rows by comparing all pairs."""
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = [d[1] or "" for d in docs]
    found = [runs(t) if len(t) < 100_000 else None for t in texts]
    for i in range(len(docs)):
        for j in range(i):
            if texts[i] == texts[j]:
                parent[find(i)] = find(j)
            elif found[i] is not None and found[j] is not None and find(i) != find(j):
                a, b = found[i], found[j]
                if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                    if len(set(a) & set(b)) >= 0.44 * (len(a) + len(b)) and alike(a, b) >= 0.8:
                        parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d[0])
    return Counter(tuple(sorted(g, key=str)) for g in groups.values())


def test_classes_are_those_of_all_pairs(spark, folder):
    # The two very long edge texts are exact copies.
    docs = [*EDGES, *planted()]
    out = N.QUERIES["op4_near_copies"](spark, folder(documents=docs)).collect()
    assert len(out) == len(docs)
    by_class = {}
    for r in out:
        by_class.setdefault(r["class_id"], []).append(r["doc_id"])
    want = brute(docs)
    # Equal ids (7, 7) with different texts share the name of their class.
    got = Counter(tuple(sorted(g, key=str)) for c, g in by_class.items() if c not in (7, None))
    assert got == Counter({g: n for g, n in want.items() if 7 not in g and None not in g})
    for c, g in by_class.items():
        assert c is None or c == min(g)


def test_a_large_bucket_of_unlike_texts_is_paired_by_rare_labels(spark, folder, monkeypatch):
    """Texts that share a long passage, hence sketches; among them some near copies of each other."""
    rng = random.Random(21)
    passage = text_of(rng, 60)
    bases = [passage + text_of(rng, 40) for _ in range(60)]
    texts = bases + [edited(rng, b, 1) for b in bases[:12]] + [b + text_of(rng, 3) for b in bases[10:20]]
    rng.shuffle(texts)
    docs = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    compared = []
    plain = N._verified
    monkeypatch.setattr(N, "PAIRED", 3)
    monkeypatch.setattr(N, "_verified", lambda pairs, *more: (compared.append(pairs.count()), plain(pairs, *more))[1])
    out = N.QUERIES["op4_near_copies"](spark, folder(documents=docs)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert Counter(tuple(sorted(g, key=str)) for g in groups.values()) == brute(docs)
    # Far fewer pairs are left than a bucket of all texts would have.
    assert compared[-1] < 3 * len(docs)


def test_one_of_each_class_stays(spark, folder):
    docs = [*EDGES, *planted()]
    table = spark.createDataFrame(
        [(*d, 1, 2) for d in docs],
        "doc_id long, text string, lang string, source string, n_chars long, copy int, root int",
    )
    kept = N.one_of_each(table)
    assert kept.columns == table.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    out = N.QUERIES["op4_near_copies"](spark, folder(documents=docs)).collect()
    want = Counter({r["class_id"] for r in out} - {7})
    assert ids[7] == 2 and ids[6] == 1 and ids[None] == 1
    del ids[7]
    assert ids == want


def test_similarity_is_that_of_the_full_table():
    rng = random.Random(4)
    for _ in range(200):
        base = text_of(rng, rng.randrange(1, 80))
        if rng.random() < 0.3:
            base = base * 2
        other = edited(rng, base, rng.randrange(0, 6)) or base
        a, b = " ".join(base), " ".join(other)
        want = alike(runs(a), runs(b))
        got = N.similarity(N.labels(a.encode()), N.labels(b.encode()))
        assert got == pytest.approx(want if want >= 0.8 - 1e-12 else 0.0), (a, b)
    moved = base[10:] + base[:10]
    assert N.similarity(N.labels(" ".join(moved).encode()), N.labels(" ".join(base).encode())) < 1


def test_bitmaps_never_lose_a_similar_pair(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        base = text_of(rng, rng.randrange(5, 400))
        other = edited(rng, base, rng.randrange(0, len(base) // 15 + 1))
        a, b = (N.labels(" ".join(t).encode()) for t in (base, other))
        rows.append((N.similarity(a, b), len(a), N.parity(a).tolist(), len(b), N.parity(b).tolist()))
        c = N.labels(" ".join(text_of(rng, len(base))).encode())
        rows.append((N.similarity(a, c), len(a), N.parity(a).tolist(), len(c), N.parity(c).tolist()))
    df = spark.createDataFrame(rows, "s double, n long, bits array<long>, m long, others array<long>")
    out = df.select("s", N._within("bits", "n", "others", "m", 0.8).alias("w")).collect()
    assert all(r["w"] for r in out if r["s"] >= 0.8)
    assert sum(r["w"] for r in out if r["s"] == 0) < sum(r["s"] == 0 for r in out) / 3


def test_sketches_agree_about_as_often_as_they_should():
    rng = random.Random(6)
    hits = total = 0
    for _ in range(60):
        base = text_of(rng, 300)
        other = edited(rng, base, 5)
        a, b = (N.labels(" ".join(t).encode()) for t in (base, other))
        s = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        hits += np.sum(N.sketches(a) == N.sketches(b))
        total += s**N.ORDERED * N.SKETCHES
    assert hits == pytest.approx(total, rel=0.2)


def test_long_texts_are_sketched_in_pieces(monkeypatch):
    found = N.labels(" ".join(text_of(random.Random(1), 500)).encode())
    whole = N.sketches(found).tolist()
    monkeypatch.setattr(N, "PIECE", 64)
    assert N.sketches(found).tolist() == whole


def test_components_of_a_long_chain(spark):
    rows = [(bytes([0, i]), bytes([0, i + 1])) for i in range(100)] + [(b"\x02\x00", b"\x02\x01")]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in rows], "copy binary, hub binary")
    out = {bytes(r["copy"]): bytes(r["root"]) for r in N.components(links).collect()}
    assert len(out) == 101 and out[b"\x02\x01"] == b"\x02\x00"
    assert {out[bytes([0, i])] for i in range(1, 101)} == {b"\x00\x00"}


def test_empty_table(spark, folder):
    assert N.QUERIES["op4_near_copies"](spark, folder()).collect() == []
    assert N.one_of_each(spark.read.parquet(folder() + "/documents.parquet")).count() == 0
    few = folder(documents=[(1, "only one", "en", "s", 1)])
    assert [tuple(r) for r in N.QUERIES["op4_near_copies"](spark, few).collect()] == [(1, 1, True)]
