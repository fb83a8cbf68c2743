"""Language-model scores by context-tree weighting over bytes.

The next byte is eight binary decisions, one in each of 255 nodes of a code tree; each node has a
tree of contexts, the last 0 to ``DEPTH`` bytes. A context estimates its decisions by
Krichevsky-Trofimov from the counts of all training texts, and the estimates of all depths are
mixed by the weights that context-tree weighting gives them: half the probability that the context
itself gave its training decisions, against that of the longer contexts below it. The score of
a text is the log probability of its bytes and of its end; per byte, a code length.

Counts: each task counts strings of ``DEPTH`` + 1 bytes of its texts; the counts, whose number
grows with the corpus, are summed by a shuffle and written. Every context of 0 to ``DEPTH`` bytes
is kept. As the chance of a byte depends on the ``DEPTH`` bytes before it alone, the model is a
table of all strings and their code lengths. Strings are dealt to tasks by the last ``SHARED`` + 1
bytes of their contexts, so that a task holds whole subtrees: weighted chances go up to depth
``SHARED`` there, are summed by Spark, mixed here for the contexts of up to ``SHARED`` bytes (at
most 65,793, whatever the corpus) and go down again in the same tasks.

Scoring: strings that make up at least ``HEAD_STRINGS`` of all (at most 1 / ``HEAD_STRINGS`` can)
are sent to the tasks with their code lengths; other strings of a text go by string to theirs and
by text to their sum. Tables of all sizes go this way.

The unigram base counts tokens exactly. Tokens that make up at least ``HEAD`` of all (at most
1 / ``HEAD`` of them can) are sent to the tasks; other tokens of a text go by token to their
counts and by text to their sum, combined before each shuffle.

Defined results: a null text is empty and scored as its end alone; a null id is never held out;
repeated rows are learned from and scored each; without training texts every byte has chance
1 in 256 and the base is that of a single unseen token, log10(1) = 0. Tokens are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import fold, table, written

DEPTH = 5
# Bytes of the contexts that are mixed in one place.
SHARED = 2
HEAD = 2e-6
HEAD_STRINGS = 5e-7
# Strings that are mixed at once, with the rest of their subtree.
MIXED = 1 << 19
# Bytes whose strings are counted or scored at once, and whose tokens are.
PIECE = 1 << 21
SCORED = 1 << 18
SPLIT = 1 << 20
# A string times this, modulo 2^64, has its slot in the leading bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Strings whose counts a task sums before it gives them away.
SUMMED = 1 << 20
# Counts whose log gamma is taken from a table.
LISTED = 1 << 12
# Different tokens that a task counts at once.
KINDS = 200_000
END = b"\x00"
# No token is a blank, so its hash stands for the end of a text.
END_TOKEN = xxhash.xxh64_intdigest(b" ")


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``DEPTH`` zeros and before one, and where each begins."""
    before = END * DEPTH
    data = np.frombuffer(b"".join(before + t + END for t in texts), np.uint8)
    sizes = np.array([len(t) + DEPTH + 1 for t in texts], np.int64)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def _strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of ``DEPTH`` + 1 bytes that end within a text or at its end; counts."""
    data, starts = framed(texts)
    wide = data.astype(np.int64)
    n = len(wide) - DEPTH
    keys = np.zeros(n, np.int64)
    for i in range(DEPTH + 1):
        keys = (keys << 8) | wide[i:n + i]
    inside = np.ones(n, bool)
    for i in range(DEPTH):
        # A string that ends in the zeros before the next text is none.
        at = starts[1:-1] - DEPTH + i
        inside[at] = False
    return np.unique(keys[inside], return_counts=True)


def turned(strings: np.ndarray) -> np.ndarray:
    """Strings with the bytes of their contexts in reverse, so that subtrees are ranges."""
    out = np.zeros_like(strings)
    for i in range(1, DEPTH + 1):
        out = (out << 8) | ((strings >> (8 * i)) & 255)
    return (out << 8) | (strings & 255)


def string_counts(docs: DataFrame, held_out: str) -> DataFrame:
    """(string, n, m) over all texts: how often in training texts and in all, strings turned."""

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        strings, *numbers = (np.concatenate(c) for c in zip(*held))
        kinds, _, sums = _sums(strings, *numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(turned(kinds)), *[pa.array(n.astype(np.int64)) for n in sums]],
            names=["string", "n", "m"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            flags = batch.column(1).to_pylist()
            for held in (False, True):
                texts = [t.as_py() or b"" for t, h in zip(batch.column(0), flags) if h == held]
                for a, b in _pieces(texts):
                    kinds, numbers = _strings(texts[a:b])
                    found.append((kinds, numbers * (not held), numbers))
                    size += len(kinds)
                    if size > SUMMED:
                        yield counted(found)
                        found, size = [], 0
        if found:
            yield counted(found)

    return (
        docs.select(F.col("text").cast("binary"), F.col(held_out))
        .mapInArrow(count, "string long, n long, m long")
        .groupBy("string").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )


def _log_gamma(counts: np.ndarray, more: float) -> np.ndarray:
    """log gamma of counts plus a half or one: a table, then Stirling's series."""
    table = np.array([math.lgamma(n + more) for n in range(LISTED)])
    small = counts < LISTED
    if small.all():
        return table[counts.astype(np.int64)]
    x = np.maximum(counts, LISTED) + more
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return np.where(small, table[np.minimum(counts, LISTED - 1).astype(np.int64)], series)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block chance of so many zeros and ones."""
    halves = _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5)
    return halves - _log_gamma(zeros + ones, 1.0) - np.log(np.pi)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, which of them each key is, and the sums of values by key."""
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, which, [np.bincount(which, v, len(kinds)) for v in values]


def _halved(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted chance of contexts with longer ones below them, and the weight of their own."""
    own = _log_kt(zeros, ones) - np.log(2)
    half = np.logaddexp(own, below - np.log(2))
    return half, np.exp(own - half)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


class Subtrees:
    """Contexts of more than ``SHARED`` bytes at one level of the code tree, from sorted strings.

    ``layers`` has, deepest first, which context each longer one (or string) is in, the weight of
    the context's own estimate and that estimate. ``keys`` are the contexts of ``SHARED`` bytes,
    with their node, and ``zeros``, ``ones`` and ``below`` what they get from below.
    """

    def __init__(self, strings: np.ndarray, n: np.ndarray, level: int):
        self.bit = (strings >> (7 - level)) & 1
        keys = strings >> (8 - level)
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        which, keys = np.cumsum(first) - 1, keys[first]
        zeros, ones = (np.bincount(which, n * b, len(keys)) for b in (1 - self.bit, self.bit))
        weighted = _log_kt(zeros, ones)
        self.layers = [(which, np.ones(len(keys)), _estimate(zeros, ones))]
        node = (1 << level) - 1
        for depth in range(DEPTH - 1, SHARED - 1, -1):
            shorter = (keys >> (8 + level) << level) | (keys & node)
            keys, which, (zeros, ones, below) = _sums(shorter, zeros, ones, weighted)
            if depth > SHARED:
                weighted, weight = _halved(zeros, ones, below)
                self.layers.append((which, weight, _estimate(zeros, ones)))
        self.keys = (keys >> level << 8) | (1 << level) | (keys & node)
        self.zeros, self.ones, self.below, self.inside = zeros, ones, below, which

    def bits(self, keys: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Code length of each string's decision at this level, by ``shared_contexts``."""
        at = np.searchsorted(keys, self.keys)[self.inside]
        mixed, left = mixed[at], left[at]
        for i in range(len(self.layers) - 1, -1, -1):
            which, weight, estimate = self.layers[i]
            mixed, left = mixed + left * weight * estimate, left * (1 - weight)
            mixed, left = mixed[which], left[which]
        one = np.clip(mixed, 1e-12, 1 - 1e-12)
        return -np.log2(np.where(self.bit == 1, one, 1 - one))


def shared_contexts(
    keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What contexts of up to ``SHARED`` bytes add to the chance of a one, and the weight left.

    Keys, sorted, come first; each is a context of ``SHARED`` bytes and a node of the code tree.
    """
    order = np.argsort(keys)
    keys, zeros, ones, below = (c[order] for c in (keys, zeros, ones, below))
    first, layers = keys, []
    for _ in range(SHARED, -1, -1):
        weighted, weight = _halved(zeros, ones, below)
        part = weight * _estimate(zeros, ones)
        shorter = (keys >> 16 << 8) | (keys & 255)
        keys, which, (zeros, ones, below) = _sums(shorter, zeros, ones, weighted)
        layers.append((which, weight, part))
    mixed, left = np.zeros(len(keys)), np.ones(len(keys))
    for which, weight, part in reversed(layers):
        mixed, left = mixed[which], left[which]
        mixed, left = mixed + left * part, left * (1 - weight)
    return first, mixed, left


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Strings, counts in training texts and in all, of whole subtrees at a time."""
    held, size, shift = [], 0, 8 * (DEPTH - SHARED)
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("string", "n", "m")])
        size += batch.num_rows
        if size < MIXED:
            continue
        strings, *counts = (np.concatenate(c) for c in zip(*held))
        cut = np.searchsorted(strings, strings[-1] >> shift << shift)
        if cut:
            yield strings[:cut], *(c[:cut] for c in counts)
        held = [[strings[cut:], *(c[cut:] for c in counts)]]
        # A subtree larger than that is read to its end.
        size = len(strings) - cut if cut else 0
    if held and sum(len(h[0]) for h in held):
        yield tuple(np.concatenate(c) for c in zip(*held))


def string_bits(counts: DataFrame) -> DataFrame:
    """(string, m, bits): the code length of the last byte of every string, by all contexts."""
    spark = counts.sparkSession
    dealt = counts.repartition(F.shiftright("string", 8 * (DEPTH - SHARED))).sortWithinPartitions("string")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, n, _ in _subtrees(batches):
            for level in range(8):
                t = Subtrees(strings, n, level)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (t.keys, t.zeros, t.ones, t.below)],
                    names=["key", "zeros", "ones", "below"],
                )

    sums = (
        dealt.mapInArrow(up, "key long, zeros double, ones double, below double")
        .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    )
    # Plain arrays, so that it does not matter how a worker comes by the class.
    shared = spark.sparkContext.broadcast(shared_contexts(*(c.to_numpy() for c in sums.columns)))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, n, m in _subtrees(batches):
            bits = sum(Subtrees(strings, n, level).bits(*shared.value) for level in range(8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(strings), pa.array(m), pa.array(bits.astype(np.float32))],
                names=["string", "m", "bits"],
            )

    return dealt.mapInArrow(down, "string long, m long, bits float")


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


class StringTable:
    """Code lengths of the frequent strings, in a table of slots by a hash of the string.

    A string is in the first slot from its own on that was free; half of all slots are empty or more.
    """

    def __init__(self, strings: np.ndarray, bits: np.ndarray):
        self.shift = np.uint64(64 - max(len(strings) * 2, 2).bit_length())
        # No string is negative. Slots past the last are for runs that begin near it.
        n = (1 << (64 - int(self.shift))) + len(strings) + 1
        self.strings, self.bits = np.full(n, -1, np.int64), np.zeros(n)
        left, at = np.arange(len(strings)), self._slots(strings)
        while len(left):
            free = self.strings[at] < 0
            self.strings[at[free]] = strings[left[free]]
            put = self.strings[at] == strings[left]
            self.bits[at[put]] = bits[left[put]]
            left, at = left[~put], at[~put] + 1

    def _slots(self, strings: np.ndarray) -> np.ndarray:
        return ((strings.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def _found(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each string and whether it is frequent."""
        at = self._slots(strings)
        there = self.strings[at]
        hit = there == strings
        bits = np.where(hit, self.bits[at], 0.0)
        left = np.flatnonzero(~hit & (there >= 0))
        at = at[left]
        while len(left):
            at += 1
            there = self.strings[at]
            same = there == strings[left]
            bits[left[same]], hit[left[same]] = self.bits[at[same]], True
            on = ~same & (there >= 0)
            left, at = left[on], at[on]
        return bits, hit

    def code_lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the frequent strings of each text; the other strings, and where each text's begin."""
        data, starts = framed(texts)
        wide, n = data.astype(np.int64), len(data) - DEPTH
        keys = wide[:n] << 8
        for i in range(1, DEPTH):
            # The context in reverse, then the byte.
            keys |= wide[i:n + i] << (8 * (i + 1))
        keys |= wide[DEPTH:]
        bits, hit = self._found(keys)
        # keys[i] ends at data[i + DEPTH]: a text's are from its start on; what ends in the zeros
        # before the next text is of none.
        inside = np.ones(n, bool)
        for i in range(DEPTH):
            inside[starts[1:-1] - DEPTH + i] = False
        sums = np.concatenate([[0.0], np.cumsum(np.where(inside, bits, 0.0))])
        rare = inside & ~hit
        before = np.concatenate([[0], np.cumsum(rare)])
        ends = np.append(starts[:-1], n)
        return np.diff(sums[ends]), keys[rare], before[ends]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token which text it is in and which of the kinds it is; hashes of the kinds.

    The end of a text is a token, the last of the kinds.
    """
    lower = pa.array([t.lower() for t in texts], pa.binary()).view(pa.string())
    lists = pc.ascii_split_whitespace(lower)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    found = lists.flatten().dictionary_encode()
    kinds, which = found.dictionary.view(pa.binary()).to_pylist(), found.indices.to_numpy()
    if b"" in kinds:
        # Before the first blank or behind the last.
        word = which != kinds.index(b"")
        of, which = of[word], which[word]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, kinds), np.uint64, len(kinds))
    return (
        np.concatenate([of, np.arange(len(texts))]),
        np.concatenate([which, np.full(len(texts), len(kinds))]),
        np.append(hashes, np.uint64(END_TOKEN)).view(np.int64),
    )


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of all tokens and ends of texts, by hash."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        kinds, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return kinds, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in summed(held)], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0)]
            for a, b in _pieces(texts, SPLIT):
                _, which, hashes = tokens(texts[a:b])
                n = np.bincount(which, minlength=len(hashes))
                held.append((hashes[n > 0], n[n > 0]))
                size += len(held[-1][0])
                if size <= 2 * KINDS:
                    continue
                held = [summed(held)]
                size = len(held[0][0])
                if size > KINDS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return (
        docs.select(F.col("text").cast("binary")).mapInArrow(count, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
    )


class Head:
    """Hashes, which are sorted, and counts of the frequent tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.logs = hashes, np.log10(counts + 1.0)

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Of each text its tokens with the end; those that are frequent and the sum of their
        log10(count + 1); the others and how often."""
        n = len(texts)
        of, which, hashes = tokens(texts)
        hit, logs = np.zeros(len(hashes), bool), np.zeros(len(hashes))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            logs = np.where(hit, self.logs[at], 0.0)
        known = hit[which]
        others, numbers = np.unique(of[~known] * len(hashes) + which[~known], return_counts=True)
        starts = pa.array(np.searchsorted(others, np.arange(n + 1) * len(hashes)), pa.int32())
        return (
            np.bincount(of, minlength=n), np.bincount(of[known], minlength=n),
            np.bincount(of, logs[which], n),
            pa.ListArray.from_arrays(starts, pa.array(hashes[others % len(hashes)])),
            pa.ListArray.from_arrays(starts, pa.array(numbers)),
        )


ROWS = (
    "key long, {}held_out boolean, n_tokens long, n_known long, logs double, bits double, "
    "n_bytes long, tokens array<long>, numbers array<long>, strings array<long>"
)


def scores(docs: DataFrame, held_out: str, head: float = HEAD) -> DataFrame:
    """Scores of all texts by what is learned from those where ``held_out`` is false.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte, the code length.
    """
    spark = docs.sparkSession
    training = docs.filter(~F.col(held_out))
    of_string = written(string_bits(written(string_counts(docs, held_out), "strings")), "bits")
    every = of_string.agg(F.sum("m")).first()[0] or 0
    found = of_string.filter(F.col("m") >= HEAD_STRINGS * every).toArrow()
    model = spark.sparkContext.broadcast(_sorted(
        found.column("string").to_numpy(), found.column("bits").to_numpy().astype(np.float64)
    ))
    counts = written(token_counts(training), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    found = counts.filter(F.col("n") >= head * total).toArrow()
    frequent = spark.sparkContext.broadcast(
        _sorted(found.column("token").to_numpy(), found.column("n").to_numpy())
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        strings, known = StringTable(*model.value), Head(*frequent.value)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            bits, others = _bits(strings, texts)
            # A batch without rows is one piece.
            parts = [known.split(texts[a:b]) for a, b in _pieces(texts, SPLIT)] or [known.split([])]
            *numbers, rare, times = zip(*parts)
            n_tokens, n_known, logs = map(np.concatenate, numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(texts))), batch.column("doc_id"),
                 batch.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(logs),
                 pa.array(bits), pa.array([len(t) for t in texts], pa.int64()),
                 pa.concat_arrays(rare), pa.concat_arrays(times), others],
                names=["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "bits", "n_bytes",
                       "tokens", "numbers", "strings"],
            )
            number += len(texts)

    read = docs.select(
        "doc_id", F.col(held_out).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    rows = written(read.mapInArrow(score, ROWS.format(f"doc_id {kind}, ")), "scored")
    rare = rows.select("key", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("numbers").alias("m"))))
    of_rare = (
        rare.join(counts, "token")
        .groupBy("key")
        .agg(F.sum("m").alias("_known"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("_logs"))
    )
    none = F.lit(0)
    of_others = (
        rows.select("key", F.explode("strings").alias("string"))
        .join(of_string.select("string", F.col("bits").alias("_bits")), "string")
        .groupBy("key").agg(F.sum(F.col("_bits").cast("double")).alias("_bits"))
    )
    bits = F.col("bits") + F.coalesce("_bits", F.lit(0.0))
    scored = (
        rows.drop("tokens", "numbers", "strings").join(of_rare, "key", "left")
        .join(of_others, "key", "left").withColumn("bits", bits)
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("_known", none)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0))
         - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _bits(table: StringTable, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Bits of the frequent strings of texts, and per text the other strings."""
    bits, others = [np.zeros(0)], [pa.array([], pa.list_(pa.int64()))]
    for a, b in _pieces(texts, SCORED):
        known, strings, starts = table.code_lengths(texts[a:b])
        bits.append(known)
        others.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(strings)))
    return np.concatenate(bits), pa.concat_arrays(others)


def _pieces(texts: list[bytes], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, by default ``PIECE``."""
    most = most or PIECE
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + DEPTH + 1
    if start < len(texts):
        yield start, len(texts)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs.withColumn("held_out", fold("doc_id", 7) == 2), "held_out")


QUERIES = {"op7_language_model": op7_language_model}
CHECKS: dict[str, str] = {}
