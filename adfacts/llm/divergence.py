"""How the words of each source differ from those of other sources and of its language.

Chunk factorization: texts are cut at ASCII white space, which no term holds. Tasks count the chunks
of each document and pass on, for blocks of documents, one row per language and chunk: in how
many documents it stands, how often in each source, and, if there are fewer than ``LEAST``, in
which documents. These rows are dealt by chunk and summed, once; so what is shuffled are distinct
chunks of blocks, not those of documents. The task that has the sums of a chunk tokenizes it, once
per language, and joins its terms to them; runs of chunks pass on one row per language and term, of the
same form, which are dealt by term and summed, once. Nothing is joined back or shuffled a third time.

A term is kept if it stands in at least ``LEAST`` documents of a language. It does if one of its
chunks does. Otherwise, as for ``Term,`` and ``term.`` in six documents each, all documents of its
chunks are listed, and distinct ones are counted while rows are summed; from ``LEAST`` on the list ends.

Rows come sorted by a hash of language and chunk or term, as Spark sorts whole numbers without
comparing; rows of one hash are told apart by language and chunk or term.

Chances p of kept terms are whole billionths. For pairs of sources, the chances of one term in all
sources of a language are one row, and tasks sum the divergences of all pairs over their rows;
partial sums are as many as there are pairs. Pairs are listed completely, as the contract asks.

Defined results: null text, language and source are empty texts; a source without terms has a
row per other source; a language without kept terms has pairs of value 0; equal rows are
documents each; nothing else is read, and a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adfacts.llm.common import table, with_group_values, written

# Documents of a language that a kept term stands in.
LEAST = 10
# Terms listed per source.
LISTED = 10
BILLION = 1_000_000_000
# Chunks, as they stand in texts, that a task counts at once.
BLOCK = 1 << 22
# Chances that a task compares at once.
CELLS = 1 << 20
# Bytes of texts that a task counts and cuts at once, if they are several.
BLOCK_BYTES, PIECE_BYTES = 1 << 27, 1 << 22
# Numbers of sources and documents of terms that a task sums at once, before the chunks they come of are merged.
ENTRIES = 1 << 20
# No letter: an ASCII character that is not A-Z or a-z.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# The same for bytes: A-Z to a-z, no letters to blanks; bytes of longer UTF-8 sequences stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
# Per block: sources by their hashes and how often, then documents, packed as whole numbers.
PACKED = "lang string, chunk binary, docs long, packed binary"
COUNTS = "lang string, chunk binary, docs long, sources array<long>, numbers array<long>, doc_keys array<long>"
# Per run of chunks: as above.
PACKED_TERMS = "lang string, term string, docs long, packed binary"
KEPT = "lang string, term string, sources array<long>, numbers array<long>"
# Up to this, a whole number times a billion is a long.
LONG = 9_000_000_000


class _Numbers(dict):
    """Numbers keys in the order they are met."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _packed(outer: np.ndarray, sources: np.ndarray, numbers: np.ndarray, inner: np.ndarray, keys: np.ndarray) -> pa.Array:
    """One binary value per row: how many sources, these, their numbers, and the document keys."""
    n, m = np.diff(outer), np.diff(inner)
    ends = np.cumsum(1 + 2 * n + m)
    begins = ends - (1 + 2 * n + m)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    data[begins] = n
    at = np.repeat(begins + 1 - outer[:-1], n) + np.arange(len(sources))
    data[at], data[at + np.repeat(n, n)] = sources, numbers
    data[np.repeat(begins + 1 + 2 * n - inner[:-1], m) + np.arange(len(keys))] = keys
    offsets = (np.concatenate([[0], ends]) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, source and number of all entries; row and key of all documents."""
    _, offsets, data = packed.buffers()
    offsets = np.frombuffer(offsets, np.int32)[packed.offset:packed.offset + len(packed) + 1] // 8
    data = np.frombuffer(data, np.int64) if data else np.zeros(0, np.int64)
    begins = offsets[:-1].astype(np.int64)
    n = data[begins]
    m = np.diff(offsets) - 1 - 2 * n
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(begins + 1 - (np.cumsum(n) - n), n) + np.arange(len(row))
    of_key = np.repeat(np.arange(len(m)), m)
    keys = np.repeat(begins + 1 + 2 * n - (np.cumsum(m) - m), m) + np.arange(len(of_key))
    return row, data[at], data[at + np.repeat(n, n)], of_key, data[keys]


def _block(
    first: int, chunks: pa.Array | _Numbers, ids: list[np.ndarray], groups: list[tuple[str, int]], least: int
) -> pa.RecordBatch:
    """Counts of a block of documents, whose chunks are ``ids`` and whose keys begin at ``first``."""
    if not isinstance(chunks, pa.Array):
        chunks = pa.array(list(chunks), pa.binary())
    langs, sources = _Numbers(), _Numbers()
    lang = np.array([langs[g[0]] for g in groups], np.int64)
    source = np.array([sources[g[1]] for g in groups], np.int64)
    every = np.concatenate(ids).astype(np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(i) for i in ids])
    # Chunks of each document and how often.
    pairs, n = np.unique(doc << 32 | every, return_counts=True)
    doc, chunk = pairs >> 32, pairs & 0xFFFFFFFF
    key = (lang[doc] * len(chunks) + chunk) * len(sources) + source[doc]
    order = np.argsort(key, kind="stable")
    key, doc, n = key[order], doc[order], n[order]
    by_source = _starts(key)
    own = key // len(sources)
    by_chunk = _starts(own)
    docs = np.diff(np.append(by_chunk, len(own)))
    few = docs < least
    # Where a chunk's sources begin, among all (chunk, source), and its documents, among the few.
    outer = np.append(np.searchsorted(by_source, by_chunk), len(by_source))
    inner = np.concatenate([[0], np.cumsum(np.where(few, docs, 0))])
    kept = np.repeat(few, docs)
    own = own[by_chunk]
    hashes = np.array(list(sources), np.int64)[key[by_source] % len(sources)]
    numbers = np.add.reduceat(n, by_source) if len(n) else n
    return pa.RecordBatch.from_arrays(
        [pa.array(list(langs), pa.string()).take(pa.array(own // max(len(chunks), 1))),
         chunks.take(pa.array(own % max(len(chunks), 1))),
         pa.array(docs, pa.int64()), _packed(outer, hashes, numbers, inner, first + doc[kept])],
        names=["lang", "chunk", "docs", "packed"],
    )


def _pieces(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the given rows stand, and which of these rows each belongs to."""
    n = np.diff(offsets)[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(len(of)), of


@dataclass
class Rows:
    """Chunks or terms of languages: documents, sources and how often, and the document keys if these are few."""

    key: np.ndarray
    lang: pa.Array
    word: pa.Array
    docs: np.ndarray
    outer: np.ndarray
    source: np.ndarray
    number: np.ndarray
    inner: np.ndarray
    doc: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Rows:
        key, lang, word, docs, packed = batch.columns
        row, source, number, of_key, doc = _unpacked(packed)
        outer, inner = (np.searchsorted(r, np.arange(len(docs) + 1)) for r in (row, of_key))
        return cls(key.to_numpy(), lang, word, docs.to_numpy(), outer, source, number, inner, doc)

    @classmethod
    def concat(cls, parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        langs, words = (pa.concat_arrays([getattr(p, name) for p in parts]) for name in ("lang", "word"))
        plain = {n: np.concatenate([getattr(p, n) for p in parts]) for n in ("key", "docs", "source", "number", "doc")}
        outer, inner = (
            np.concatenate([[0], np.cumsum(np.concatenate([np.diff(getattr(p, n)) for p in parts]))])
            for n in ("outer", "inner")
        )
        return cls(lang=langs, word=words, outer=outer, inner=inner, **plain)

    def slice(self, start: int, end: int) -> Rows:
        outer, inner = self.outer[start:end + 1], self.inner[start:end + 1]
        return Rows(
            self.key[start:end], self.lang.slice(start, end - start), self.word.slice(start, end - start),
            self.docs[start:end], outer - outer[0], self.source[outer[0]:outer[-1]], self.number[outer[0]:outer[-1]],
            inner - inner[0], self.doc[inner[0]:inner[-1]],
        )

    def arrays(self) -> list[pa.Array]:
        outer, inner = (pa.array(o, pa.int32()) for o in (self.outer, self.inner))
        return [
            pa.ListArray.from_arrays(outer, pa.array(self.source)), pa.ListArray.from_arrays(outer, pa.array(self.number)),
            pa.ListArray.from_arrays(inner, pa.array(self.doc)),
        ]

    def packed(self) -> pa.Array:
        return _packed(self.outer, self.source, self.number, self.inner, self.doc)


def _sources_of(group: np.ndarray, source: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Sources of ``n`` groups once each, with sums: where a group's begin, sources, sums."""
    hashes, code = np.unique(source, return_inverse=True)
    width = max(len(hashes), 1)
    pairs, which = np.unique(group * width + code, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, which, number)
    source = hashes[pairs % width] if len(hashes) else pairs
    return np.searchsorted(pairs, np.arange(n + 1) * width), source, sums


def _documents_of(group: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of ``n`` groups once each: where a group's begin, documents."""
    order = np.lexsort((doc, group))
    group, doc = group[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(group[first], np.arange(n + 1)), doc[first]


def _merged(
    rows: Rows, at: np.ndarray, times: np.ndarray, group: np.ndarray, n: int, least: int, again: bool
) -> tuple[np.ndarray, ...]:
    """Documents, sources and document keys of ``n`` groups of the rows ``at``, whose numbers count ``times``.

    With ``again``, rows of a group may have the same documents.
    """
    entry, of = _pieces(rows.outer, at)
    outer, source, number = _sources_of(group[of], rows.source[entry], rows.number[entry] * times[of], n)
    entry, of = _pieces(rows.inner, at)
    inner, doc = _documents_of(group[of], rows.doc[entry], n)
    docs = np.zeros(n, np.int64)
    (np.maximum if again else np.add).at(docs, group, rows.docs[at])
    if again:
        docs = np.where(docs < least, np.diff(inner), docs)
    few = docs < least
    kept, _ = _pieces(inner, np.flatnonzero(few))
    inner = np.concatenate([[0], np.cumsum(np.where(few, np.diff(inner), 0))])
    return docs, outer, source, number, inner, doc[kept]


class Sums:
    """Sums of rows that come sorted by the hash of language and chunk or term; the last hash may go on.

    Documents are different ones in all rows of a chunk. Those of a term may be the same (``again``), so they are
    counted while they are listed; from ``least`` on, the number is a bound that they reach.
    """

    def __init__(self, least: int, again: bool = False):
        self.least, self.again, self.held = least, again, None

    def add(self, batch: pa.RecordBatch) -> Rows:
        """The groups that are complete, with those of earlier batches."""
        rows = Rows.read(batch)
        if self.held is not None:
            rows = Rows.concat([self.held, rows])
        rows = self._summed(rows)
        last = int(np.searchsorted(rows.key, rows.key[-1]))
        self.held = rows.slice(last, len(rows.key))
        return rows.slice(0, last)

    def rest(self) -> Iterator[Rows]:
        if self.held is not None:
            yield self.held

    @staticmethod
    def _groups(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """The group of each row, and where each group begins."""
        n = len(rows.key)
        begins, tied = np.ones(n, bool), rows.key[1:] == rows.key[:-1]
        unequal = np.zeros(n - 1, bool)
        for column in (rows.word, rows.lang):
            unequal |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins[1:] = unequal | ~tied
        if not (unequal & tied).any():
            return np.cumsum(begins) - 1, np.flatnonzero(begins)
        # Rows of different words with the same hash may take turns.
        numbers = _Numbers()
        every = zip(rows.key.tolist(), rows.lang.to_pylist(), rows.word.to_pylist())
        group = np.array([numbers[k] for k in every], np.int64)
        return group, np.unique(group, return_index=True)[1]

    def _summed(self, rows: Rows) -> Rows:
        group, starts = self._groups(rows)
        every, at = np.arange(len(group)), pa.array(starts)
        sums = _merged(rows, every, np.ones_like(every), group, len(starts), self.least, self.again)
        return Rows(rows.key[starts], rows.lang.take(at), rows.word.take(at), *sums)


def _listed(chunks: Rows, least: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [chunks.lang, chunks.word, pa.array(chunks.docs), *chunks.arrays()],
        names=["lang", "chunk", "docs", "sources", "numbers", "doc_keys"],
    )


def _terms(chunks: Rows, least: int) -> pa.RecordBatch:
    """Counts of the terms of chunks, which are tokenized once each."""
    found = [c.translate(TERM_BYTES).split() for c in chunks.word.to_pylist()]
    terms = _Numbers()
    each = np.fromiter(map(len, found), np.int64, len(found))
    term = np.fromiter(map(terms.__getitem__, chain.from_iterable(found)), np.int64, int(each.sum()))
    width = max(len(terms), 1)
    # Terms of each chunk and how often.
    pairs, times = np.unique(np.repeat(np.arange(len(found)), each) * width + term, return_counts=True)
    chunk, term = pairs // width, pairs % width
    langs = chunks.lang.dictionary_encode()
    groups, group = np.unique(langs.indices.to_numpy()[chunk] * width + term, return_inverse=True)
    docs, *sums = _merged(chunks, chunk, times, group, len(groups), least, True)
    names = pa.array([t.decode(errors="replace") for t in terms], pa.string())
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(groups // width)), names.take(pa.array(groups % width)),
         pa.array(docs), _packed(*sums)],
        names=["lang", "term", "docs", "packed"],
    )


def _split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of one text, or several with ``PIECE_BYTES`` at most."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, and how many each has. Bytes are cut at ASCII white space, whatever they encode."""
    found = pc.ascii_split_whitespace(texts.view(pa.string()))
    every = found.flatten()
    # What stands before leading and after trailing white space is empty.
    filled = pc.binary_length(every).to_numpy() > 0
    of = np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy())
    return every.filter(pa.array(filled)).view(pa.binary()), np.bincount(of[filled], minlength=len(texts))


def _summed(batches: Iterator[pa.RecordBatch], sums: Sums) -> Iterator[Rows]:
    for batch in batches:
        if batch.num_rows:
            yield sums.add(batch)
    yield from sums.rest()


def _runs(chunks: Iterator[Rows]) -> Iterator[Rows]:
    """The same rows, one or several with about ``ENTRIES`` numbers at most once their terms are told apart."""
    held, size = [], 0
    for part in chunks:
        terms = pc.binary_length(part.word).to_numpy().astype(np.int64) // 4 + 1
        ends, start = np.cumsum((1 + np.diff(part.outer) + np.diff(part.inner)) * terms), 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, before + ENTRIES - size, "right")), start + (not held))
            if end > start:
                held.append(part.slice(start, end))
                size, start = size + int(ends[end - 1]) - before, end
            if start < len(ends):
                yield Rows.concat(held)
                held, size = [], 0
    if held:
        yield Rows.concat(held)


def _dealt(rows: DataFrame, word: str) -> DataFrame:
    """Rows of the same language and chunk or term one after the other, after their hash."""
    dealt = rows.repartition("lang", word).select(F.xxhash64("lang", word).alias("key"), "lang", word, "docs", "packed")
    return dealt.sortWithinPartitions("key")


def chunk_counts(
    docs: DataFrame, least: int = LEAST, passed: Callable[[Rows, int], pa.RecordBatch] = _listed, schema: str = COUNTS
) -> DataFrame:
    """A row per language and chunk; see ``COUNTS``. ``doc_keys`` are all if they are few.

    ``docs`` has text, lang and ``source_key``, a number for each source. What is returned of runs of
    chunks is what ``passed`` makes of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 40, 0, 0
        chunks, lengths, groups = [], [], []

        def block() -> pa.RecordBatch:
            coded = pa.chunked_array(chunks).dictionary_encode().unify_dictionaries()
            every = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            ids = np.split(every, np.cumsum(np.concatenate(lengths))[:-1])
            names = coded.chunk(0).dictionary
            # Freed before the block is counted, also for other processes beside this worker.
            del coded
            chunks.clear()
            pa.default_memory_pool().release_unused()
            return _block(first, names, ids, groups, least)

        for piece in _split_up(batches):
            found, n = _chunks(piece.column("text"))
            if not len(found):
                continue
            if chunks and (held + len(found) > BLOCK or size + piece.nbytes > BLOCK_BYTES):
                yield block()
                first, held, size = first + len(groups), 0, 0
                chunks, lengths, groups = [], [], []
            chunks.append(found)
            lengths.append(n)
            groups += zip(piece.column("lang").to_pylist(), piece.column("source_key").to_pylist())
            held, size = held + len(found), size + piece.nbytes
        if chunks:
            yield block()
        pa.default_memory_pool().release_unused()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(_summed(batches, Sums(least))):
            yield passed(run, least)

    blocks = docs.select(F.col("text").cast("binary"), "lang", "source_key").mapInArrow(count, PACKED)
    return _dealt(blocks, "chunk").mapInArrow(add, schema)


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per language and term in at least ``least`` documents, written; see ``KEPT``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _summed(batches, Sums(least, again=True)):
            sources, numbers, _ = rows.arrays()
            found = pa.RecordBatch.from_arrays(
                [rows.lang, rows.word, sources, numbers], names=["lang", "term", "sources", "numbers"]
            )
            yield found.filter(pa.array(rows.docs >= least))

    terms = chunk_counts(docs, least, _terms, PACKED_TERMS)
    return written(_dealt(terms, "term").mapInArrow(add, KEPT), "terms")


def chance(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kinds)), exactly. Longs are used where they suffice."""
    n, below = (n + 2).cast("long"), (total + 2 * kinds).cast("long")
    wide = F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * n.cast("decimal(19,0)"), below.cast("decimal(20,0)"))
    return F.when(n <= LONG, F.call_function("div", n * BILLION, below)).otherwise(wide) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(chances: DataFrame) -> DataFrame:
    """(lang, a, b, value): divergence of sources a < b, by number, over all rows.

    ``chances`` has a row per language and term: ``zeros``, the chance that each source of the
    language gives to a term it lacks, and ``own``, (number, p) of the sources that have it.
    """

    def matrices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        langs = batch.column("lang").dictionary_encode()
        of = langs.indices.to_numpy()
        for which, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(of == which)))
            zeros = rows.column("zeros")[0].values.to_numpy()
            step = max(CELLS // len(zeros), 1)
            for start in range(0, len(rows), step):
                own = rows.column("own").slice(start, step)
                filled = np.tile(zeros, (len(own), 1))
                entries = own.flatten()
                row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                filled[row, entries.field("number").to_numpy()] = entries.field("p").to_numpy()
                yield lang, filled

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, filled in matrices(batch):
                width = filled.shape[1]
                for a in range(width - 1):
                    p, q = filled[:, a:a + 1], filled[:, a + 1:]
                    value = ((p - q) ** 2 // (p + q)).sum(0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value), pa.string()), pa.array([a] * len(value), pa.int32()),
                         pa.array(range(a + 1, width), pa.int32()), pa.array(value, pa.int64())],
                        names=["lang", "a", "b", "value"],
                    )

    return (
        chances.select("lang", "zeros", "own").mapInArrow(add, "lang string, a int, b int, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def source_divergence(docs: DataFrame, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and top terms of each source."""
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])
    sources = docs.select("lang", "source").distinct().withColumn("source_key", F.xxhash64("source"))
    if sources.select("source", "source_key").distinct().groupBy("source_key").count().filter("count > 1").count():
        raise ValueError("two sources have the same hash")
    kept = kept_terms(docs.withColumn("source_key", F.xxhash64("source")), least)
    found = kept.select("lang", "term", F.inline(F.arrays_zip("sources", "numbers")).alias("source_key", "n"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = found.groupBy("lang", "source_key").agg(F.sum("n").alias("total"))
    groups = written(
        sources.join(totals, ["lang", "source_key"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
        .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1),
        "groups",
    )
    zero = F.when(F.col("kinds") > 0, chance(F.lit(0).cast("long"), F.col("total"), F.col("kinds")))
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.first("kinds").alias("lang_kinds"),
        F.sort_array(F.collect_list(F.struct(F.col("number"), zero.alias("p"))))["p"].alias("zeros"),
    )
    of_group = with_group_values(found, groups, ["lang", "source_key"])
    own = F.struct("number", chance(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    by_term = of_group.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.collect_list(own).alias("own"))
    chances = written(
        with_group_values(by_term, langs, ["lang"]).select(
            "lang", "term", chance(F.col("lang_n"), F.col("lang_total"), F.col("lang_kinds")).alias("q"), "own"
        ),
        "chances",
    )
    sums = pair_sums(with_group_values(chances, langs.select("lang", "zeros"), ["lang"]))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "source", F.col("number").alias("a"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = (
        names.join(others, "lang").filter(F.col("a") != F.col("b"))
        .join(both, ["lang", "a", "b"], "left")
        .select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    )
    more = chances.select("lang", F.col("term").alias("item"), "q", F.inline("own")).filter(F.col("p") > F.col("q"))
    terms = with_group_values(more, groups.select("lang", "number", "source"), ["lang", "number"]).select(
        "lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value")
    )
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term").filter(F.col("rank") <= listed))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w
  FROM documents
),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
chances AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)
    // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p
  FROM every
),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)
    // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value,
    row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source) AS rank
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS rank FROM (
      SELECT c.lang, source, term, ((p - q) * (p - q) // (p + q))::BIGINT AS value
      FROM chances c JOIN whole USING (lang, term) WHERE n > 0 AND p > q
    )
  ) WHERE rank <= {LISTED}
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""

QUERIES = {"op12_divergence": op12_divergence}
CHECKS = {"op12_divergence": SQL}
