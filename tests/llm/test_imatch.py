import hashlib
import random
import statistics

import numpy as np
import xxhash
from edges import EDGES
from pyspark.sql import functions as F

from adfacts.llm import imatch as I
from adfacts.llm.common import words

NONE = np.zeros(0, np.uint64)


def text_of(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(n))


def documents():
    rng = random.Random(12)
    rows = [(50 + 3 * i, text_of(rng, rng.randrange(1, 400)), "en", "s", 1) for i in range(150)]
    rows += [(1000, rows[3][1], "en", "s", 1), (1001, rows[3][1].upper(), "en", "s", 1)]
    rng.shuffle(rows)
    return [*EDGES, *rows]


def in_order(docs):
    """Rows as the docstring has them: null ids first, equal ids by text."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))


def edited(docs):
    """(id, edited text) of every row."""
    rows = in_order(docs)
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        out.append((doc_id, len(text), text[:len(text) - cut] + following[:cut]))
    return out


def test_edits_take_the_next_document(spark, folder):
    docs = documents()
    path = folder(documents=docs)
    out = I.QUERIES["op3_fingerprints"](spark, path).collect()
    want = sorted((str(i), n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in edited(docs))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == want
    marks = {}
    by_id = {i: t or "" for i, t, *_ in docs}
    for r in out:
        if r["doc_id"] not in (None, 6, 7):
            assert marks.setdefault(by_id[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    whole = [r for r in out if r["n_chars"] > 200 and r["doc_id"] not in (9, 10, 999, 1000)]
    assert statistics.mean(r["near_edited"] for r in whole) > 0.35
    assert statistics.mean(r["near_next"] for r in whole) < 0.2


def test_any_number_of_ranges_pairs_the_same_documents(spark, folder):
    docs = documents()
    table = spark.read.parquet(folder(documents=docs) + "/documents.parquet")
    want = None
    for ranges in (1, 2, 7, 40):
        rows = I.with_next(table, ranges)
        parts = rows.withColumn("p", F.spark_partition_id()).collect()
        assert sum(not r["_last"] for r in parts) == len(docs)
        pairs = []
        for p in {r["p"] for r in parts}:
            before = None
            for r in (r for r in parts if r["p"] == p):
                if before is not None and before["_range"] == r["_range"]:
                    pairs.append((str(before["doc_id"]), before["text"][:50], r["text"][:50]))
                before = None if r["_last"] else r
        want = want or sorted(pairs)
        assert sorted(pairs) == want and len(pairs) == len(docs)


def test_the_lexicon_is_the_band_of_document_frequency(spark, folder):
    docs = documents()
    table = spark.read.parquet(folder(documents=docs) + "/documents.parquet")
    n = {}
    for _, text, *_ in docs:
        for w in set(words((text or "").encode())):
            n[w] = n.get(w, 0) + 1
    want = sorted(xxhash.xxh64_intdigest(w) for w, k in n.items() if 0.02 * len(docs) <= k <= 0.3 * len(docs))
    assert I.lexicon(table, 0.02, 0.3).tolist() == want


def test_subsets_hash_their_sorted_terms():
    terms = I.term_hashes(text_of(random.Random(5), 300))
    for level, hashes in I.signatures(terms).items():
        for j, seed in enumerate(I.SEEDS):
            drawn = I._mixed(terms ^ seed)
            chosen = [int(t) for t, d in zip(terms, drawn) if int(d) % (1 << level) == 0]
            assert chosen == sorted(chosen)
            want = xxhash.xxh32_intdigest(np.array(chosen, np.uint64).tobytes()) % 65535 + 1 if chosen else 0
            assert hashes[j] == want


def test_likeness_follows_the_share_of_terms():
    rng = random.Random(2)
    near, far = [], []
    for _ in range(40):
        found = text_of(rng, 300).split()
        other = found[:270] + text_of(rng, 30).split()
        near.append(I.likeness(I.fingerprint(" ".join(found), NONE), I.fingerprint(" ".join(other), NONE)))
        far.append(I.likeness(I.fingerprint(" ".join(found), NONE), I.fingerprint("z" + " z".join(found), NONE)))
    assert statistics.mean(near) > 0.6 and max(far) < 0.2
    mark = I.fingerprint("a b c", NONE)
    assert I.likeness(mark, I.fingerprint("c, B a!", NONE)) == 1.0
    assert I.likeness(I.fingerprint("", NONE), I.fingerprint("...", NONE)) == 0.0
    assert I.likeness(I.fingerprint("a", NONE), I.fingerprint(text_of(rng, 900), NONE)) == 0.0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = text_of(random.Random(1), 600)
    whole = I.fingerprint(text, NONE)
    monkeypatch.setattr(I, "PIECE", 16)
    assert I.fingerprint(text, NONE) == whole


def test_small_tables(spark, folder):
    assert I.QUERIES["op3_fingerprints"](spark, folder()).collect() == []
    (row,) = I.QUERIES["op3_fingerprints"](spark, folder(documents=[(4, "abcdefgh", "en", "s", 8)])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0
