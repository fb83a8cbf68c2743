import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edges import EDGES

from adfacts.llm import ctw as M


def strings(texts, depth):
    """Counts of (context, byte) by plain slicing, contexts of exactly ``depth`` bytes."""
    found = Counter()
    for t in texts:
        padded = b"\x00" * depth + t + b"\x00"
        for i in range(depth, len(padded)):
            found[padded[i - depth:i], padded[i]] += 1
    return found


def block(zeros, ones):
    """Log chance of the bits by Krichevsky-Trofimov, one bit after the other."""
    total, a, b = 0.0, 0.5, 0.5
    for _ in range(zeros):
        total += math.log(a / (a + b))
        a += 1
    for _ in range(ones):
        total += math.log(b / (a + b))
        b += 1
    return total


def weighted(found, node, level, context, depth):
    """Log weighted chance of all decisions at a node of the code tree, by recursion."""
    zeros = ones = 0
    longer = set()
    for (c, byte), n in found.items():
        if c.endswith(context) and byte >> (8 - level) == node:
            if byte >> (7 - level) & 1:
                ones += n
            else:
                zeros += n
            longer.add(c[len(c) - len(context) - 1:] if len(context) < depth else c)
    own = block(zeros, ones)
    if len(context) == depth:
        return own
    inner = sum(weighted(found, node, level, c, depth) for c in longer)
    return np.logaddexp(own, inner) - math.log(2)


def chance(found, context, byte, depth):
    """Chance of a byte: how the weighted chance of all data grows by it."""
    total = 0.0
    more = found + Counter({(context, byte): 1})
    for level in range(8):
        node = byte >> (8 - level)
        total += weighted(more, node, level, b"", depth) - weighted(found, node, level, b"", depth)
    return total


def code_lengths(found, wanted=()):
    """(context, byte) to bits by the operator's arrays, without Spark; ``wanted`` are not counted."""
    n = Counter({key: 0 for key in wanted})
    n.update(found)
    keys = np.array([int.from_bytes(c, "big") << 8 | b for c, b in n], np.int64)
    turned, number = M.turned(keys), np.array(list(n.values()), np.int64)
    order = np.argsort(turned)
    levels = [M.Subtrees(turned[order], number[order], level) for level in range(8)]
    shared = M.shared_contexts(*(np.concatenate([getattr(t, c) for t in levels]) for c in ("keys", "zeros", "ones", "below")))
    bits = sum(t.bits(*shared) for t in levels)
    names = list(n)
    return {names[i]: b for i, b in zip(order, bits)}


def test_chances_are_ratios_of_weighted_block_chances(monkeypatch):
    monkeypatch.setattr(M, "DEPTH", 3)
    found = strings([b"abab", b"abc", b"\xc3\xa9a"], 3)
    wanted = [(c, b) for c in (b"bab", b"\x00\x00a", b"zzz", b"zab") for b in (ord("a"), ord("b"), 0, 0xC3, 0xFF)]
    bits = code_lengths(found, wanted)
    for context, byte in wanted:
        want = -chance(found, context, byte, 3) / math.log(2)
        assert bits[context, byte] == pytest.approx(want, abs=1e-6), (context, byte)


def test_chances_of_all_bytes_sum_up_to_one():
    rng = random.Random(2)
    found = strings([bytes(rng.choices(b"abcd \n", k=60)) for _ in range(5)], M.DEPTH)
    contexts = [b"abcda", b"\x00\x00\x00\x00\x00", b"zzzzz", next(iter(found))[0]]
    bits = code_lengths(found, [(c, b) for c in contexts for b in range(256)])
    for context in contexts:
        assert sum(2.0 ** -bits[context, b] for b in range(256)) == pytest.approx(1.0, abs=1e-9)


def test_pieces_end_between_texts(monkeypatch):
    assert [b - a for a, b in M._pieces([b"x" * 5] * 4)] == [4]
    monkeypatch.setattr(M, "PIECE", 12)
    assert list(M._pieces([b"x" * 5] * 4)) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_strings_are_counted_within_texts():
    texts = [b"", b"ab", b"abc", b"\x00\x00"]
    kinds, numbers = M._strings(texts)
    want = strings(texts, M.DEPTH)
    got = {(int(k) >> 8, int(k) & 255): int(n) for k, n in zip(kinds, numbers)}
    assert got == {(int.from_bytes(c, "big"), b): n for (c, b), n in want.items()}


def documents():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(60)]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(0, 80))).title(), "en", "s", 1) for i in range(120)]
    return [*EDGES, *rows, (400, "never seen\x0bbefore Never", "en", "s", 1)]


def test_query_counts_like_a_plain_loop(spark, folder):
    docs = documents()
    # Tokens in fewer than one of fifty take the way through the shuffle.
    table = spark.read.parquet(folder(documents=docs) + "/documents.parquet").select("doc_id", "text")
    held = table.withColumn("held_out", M.fold("doc_id", 7) == 2)
    out = M.scores(held, "held_out", head=0.02).collect()

    def tokens(text):
        return (text or "").encode().lower().split() + [b" "]

    held_out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in docs}
    counts = Counter(t for i, text, *_ in docs if not held_out[i] for t in tokens(text))
    n, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held_out[i], len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n,
         round(sum(math.log10((counts[x] + 1) / (n + kinds + 1)) for x in tokens(t)), 6), len((t or "").encode()))
        for i, t, *_ in docs
    )
    got = sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
         round(r["base_score"], 6), r["n_bytes"])
        for r in out
    )
    assert got == want
    assert all(r["score"] < 0 for r in out)
    assert all(abs(r["bits_per_byte"] * r["n_bytes"] * math.log10(2) + r["score"]) < 1e-6 for r in out if r["n_bytes"])
    same = {r["doc_id"]: r["score"] for r in out}
    assert same[9] == pytest.approx(same[10])


def test_held_out_texts_are_shorter_than_without_a_model(spark, folder):
    out = M.QUERIES["op7_language_model"](spark, folder(documents=documents())).collect()
    tested = [r for r in out if r["held_out"] and r["n_bytes"] > 50]
    assert tested and all(r["bits_per_byte"] < 5 for r in tested if r["doc_id"] >= 100)


def test_nothing_to_learn_from(spark, folder):
    assert M.QUERIES["op7_language_model"](spark, folder()).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = M.QUERIES["op7_language_model"](spark, folder(documents=[(held, "ab", "en", "s", 2)])).collect()
    (row,) = out
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (2, 0, 0, 0.0)
    assert row["bits_per_byte"] == pytest.approx(12.0)  # three bytes of one chance in 256


def test_all_contexts_are_kept(spark, folder, monkeypatch):
    table = spark.read.parquet(folder(documents=documents()) + "/documents.parquet").select("doc_id", "text")
    held = table.withColumn("held_out", M.fold("doc_id", 7) == 2)
    rows = [(r["held_out"], (r["text"] or "").encode(), str(r["doc_id"])) for r in held.collect()]
    found = strings([t for h, t, _ in rows if not h], M.DEPTH)
    of_text = [(i, t, strings([t], M.DEPTH)) for _, t, i in rows]
    bits = code_lengths(found, [key for _, _, own in of_text for key in own])
    want = sorted((i, len(t), sum(n * bits[key] for key, n in own.items())) for i, t, own in of_text)
    # Rare strings joined, then all strings sent to the tasks.
    for head in (1e-3, 1e-12):
        monkeypatch.setattr(M, "HEAD_STRINGS", head)
        out = M.scores(held, "held_out").collect()
        got = sorted((str(r["doc_id"]), r["n_bytes"], -r["score"] / math.log10(2)) for r in out)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-4)


@pytest.mark.parametrize("size", [1, 20, 1000])
def test_tables_of_any_size_through_the_entry(spark, folder, size):
    import __spark_entry__ as entry

    docs = [(i, f"short text {i % 37} of some words", "en", "s", 1) for i in range(size)]
    out = entry.queries()["op7_language_model"](spark, folder(documents=docs)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(size))
    assert all(r["score"] < 0 for r in out)


def test_slots_hold_every_string_and_no_other():
    rng = np.random.default_rng(5)
    for strings in (np.zeros(0, np.int64), np.array([7]), np.arange(5000) * 3, rng.integers(0, 1 << 48, 5000)):
        strings = np.unique(strings)
        table = M.StringTable(strings, strings * 0.5)
        asked = np.concatenate([strings, strings + 1, rng.integers(0, 1 << 48, 100)])
        bits, hit = table._found(asked)
        assert (hit == np.isin(asked, strings)).all()
        assert (bits == np.where(hit, asked * 0.5, 0)).all()


def test_tokens_of_several_texts_like_split():
    texts = [b"", b" ", b"a B a", " é\x1c\t\x0b\x0c\r\nÉ x\u00a0y ".encode(), b"\xff b", b"b"]
    of, which, hashes = M.tokens(texts)
    got = sorted(zip(of.tolist(), hashes[which].view(np.uint64).tolist()))
    want = [(i, M.xxhash.xxh64_intdigest(t)) for i, text in enumerate(texts) for t in [*text.lower().split(), b" "]]
    assert got == sorted(want)
    assert [len(c) for c in M.tokens([])] == [0, 0, 1]
