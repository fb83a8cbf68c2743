"""Benchmark passages in training documents by a distributed positional inverted index.

The index is stored as a table: documents are dealt to shards of about ``SHARD_WORDS`` words, and
a shard has one row per term with the term's places in the shard, and one row (an empty term)
with its directory of documents. Building it is a projection: each task writes the shards of the
documents it reads, nothing is shuffled.

A search takes windows of ``WINDOW`` consecutive words of the items, each distinct one once. Within a
shard a window's terms are ordered by how often they stand there, rarest first. The places of the
rarest, less its place in the window, are where the window may begin; the list of every next term,
adjusted alike, is intersected with them. What is in all lists is an exact occurrence.

A proximity match is a start from which at most one term in five is not within ``SLACK`` words of its
place. As many of the rarest terms as may be missing, and one more, are its anchors: one of
them at least stands in any match, whichever terms are missing. Their places, less theirs in the window,
are filtered by the other lists with twice the slack; around those that stay, every start is
tested. Adjacent starts are one match, and none if an exact occurrence is among them.

Lists of all windows are intersected together, as arrays of (window, start). Only rows of searched
terms leave the index, dealt by shard, so that a group is as large as a shard, whatever a term or a
passage is shared by.

Windows are the query set and are read in blocks of about ``BLOCK_WINDOWS``, dealt by their words, each
of which is sent to all tasks; results of several blocks are merged per document.

Defined results: a null or empty text has no words and is clean; a null item has no window, an
item with fewer words than a window is one window; repeated items count once by id, a null id is
the empty one; repeated documents and null ids keep a row each; a text longer than a shard is a
shard of its own; ids are whole numbers, as a text that is none is null; other columns are not
read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import WORD_PATTERN, decided, settled, table, text_key, words, written

WINDOW = 10
SLACK = 2
SHARD_WORDS = 1 << 21
BLOCK_WINDOWS = 1 << 20
# (window, start) pairs that a task tests at once.
PAIRS = 1 << 22
# Words between two documents of a shard, so that no match reaches from one into the next.
GAP = 128

INDEX = (
    "shard long, term binary, n long, places binary, "
    "doc_ids array<long>, keys array<long>, starts array<long>, lengths array<long>"
)
FOUND = (
    "shard long, place long, doc_id long, _key long, n_words long, "
    "items array<string>, spans array<struct<from:int,to:int>>, n_near long"
)


class _Numbers(dict):
    """Numbers terms in the order they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _shard(number: int, docs: list[tuple], ids: list[np.ndarray], terms: dict) -> pa.RecordBatch:
    """The rows of a shard: its directory, then a row per term."""
    lengths = np.array([len(i) for i in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]])
    every = np.concatenate(ids).astype(np.uint64)
    at = np.arange(len(every)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    pairs = (every << np.uint64(32)) | at.astype(np.uint64)
    pairs.sort()
    counts = np.bincount(every.astype(np.int64), minlength=len(terms))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
    places = pa.Array.from_buffers(
        pa.binary(), len(terms),
        [None, pa.py_buffer(offsets), pa.py_buffer((pairs & np.uint64(0xFFFFFFFF)).astype("<u4"))],
    )
    none = pa.nulls(len(terms), pa.list_(pa.int64()))

    def listed(values) -> pa.Array:
        return pa.concat_arrays([pa.array([values], pa.list_(pa.int64())), none])

    return pa.RecordBatch.from_arrays(
        [pa.array([number] * (len(terms) + 1), pa.int64()),
         pa.concat_arrays([pa.array([b""]), pa.array(list(terms), pa.binary())]),
         pa.concat_arrays([pa.array([0], pa.int64()), pa.array(counts, pa.int64())]),
         pa.concat_arrays([pa.nulls(1, pa.binary()), places]),
         listed([d for d, _ in docs]), listed([k for _, k in docs]), listed(starts), listed(lengths)],
        names=["shard", "term", "n", "places", "doc_ids", "keys", "starts", "lengths"],
    )


def positional_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): written once, read by every search."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, ids, terms, held = [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, key, text in zip(*batch.columns):
                found = words(text.as_py())
                if rows and held + len(found) > shard_words:
                    yield _shard(number, rows, ids, terms)
                    number, rows, ids, terms, held = number + 1, [], [], _Numbers(), 0
                rows.append((doc_id.as_py(), key.as_py()))
                ids.append(np.fromiter(map(terms.__getitem__, found), np.uint32, len(found)))
                held += len(found)
        if rows:
            yield _shard(number, rows, ids, terms)

    read = docs.select(
        F.col("doc_id").cast("long"), text_key().alias("_key"), F.col("text").cast("binary")
    )
    return written(read.mapInArrow(build, INDEX), "index")


def item_windows(item: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``window`` words; all words if there are fewer; none of no words."""
    if len(item) <= window:
        return [tuple(item)] if item else []
    return [tuple(item[i:i + window]) for i in range(len(item) - window + 1)]


def window_rows(items: DataFrame, window: int) -> DataFrame:
    """(run, items): every distinct window, its words joined by blanks, and whose it is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(*batch.columns):
                runs = [b" ".join(run) for run in item_windows(words(text.as_py()), window)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs, pa.binary()), pa.array([item_id.as_py()] * len(runs), pa.string())],
                    names=["run", "item"],
                )

    read = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"),
    )
    runs = read.mapInArrow(cut, "run binary, item string")
    return written(runs.groupBy("run").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")


class ShardWindows:
    """Windows that may stand in a shard; their terms ordered by their counts there."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, lists: list[np.ndarray | None]):
        counts = np.array([0 if places is None else len(places) for places in lists], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        # All lists, term by term, as one sorted array.
        self.keys = np.concatenate(
            [np.zeros(0, np.int64)]
            + [np.int64(t << 32) + places for t, places in enumerate(lists) if places is not None]
        )
        real = terms >= 0
        there = ((counts[terms] > 0) & real).sum(1)
        self.numbers = np.flatnonzero(there >= lengths - lengths // 5)
        terms, real = terms[self.numbers], real[self.numbers]
        self.lengths = lengths[self.numbers]
        self.allowed = self.lengths // 5
        often = np.where(real, counts[terms], np.iinfo(np.int64).max)
        # Terms rarest first, with their places in the window.
        self.place = np.argsort(often, axis=1, kind="stable")
        self.term = np.take_along_axis(terms, self.place, 1)
        self.counts = counts

    def starts_of(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) for every place of the ``k``-th rarest term of windows."""
        term, place = self.term[rows, k], self.place[rows, k]
        n = self.counts[term]
        row = np.repeat(rows, n)
        first = np.repeat(self.begin[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        at = self.keys[first + np.arange(len(row))] & 0xFFFFFFFF
        return row, at - np.repeat(place, n)

    def has(self, row: np.ndarray, start: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Whether the ``k``-th rarest term is within ``slack`` words of its place."""
        term = self.term[row, k]
        wanted = start + self.place[row, k]
        low = (term << 32) + np.maximum(wanted - slack, 0)
        at = np.searchsorted(self.keys, low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= (term << 32) + wanted + slack) & (wanted + slack >= 0)

    def kept(
        self, row: np.ndarray, start: np.ndarray, slack: int, allowed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which no more terms than ``allowed`` are absent."""
        misses = np.zeros(len(row), np.int64)
        for k in range(self.term.shape[1]):
            tested = k < self.lengths[row]
            misses += tested & ~self.has(row, start, k, slack)
            stay = misses <= allowed[row]
            row, start, misses = row[stay], start[stay], misses[stay]
            if not len(row):
                break
        return row, start

    def pieces(self) -> Iterator[np.ndarray]:
        """Runs of windows whose anchors have about ``PAIRS`` places."""
        width = self.term.shape[1]
        anchors = np.arange(width)[None, :] <= self.allowed[:, None]
        n = np.where(anchors, self.counts[self.term], 0).sum(1)
        piece = np.cumsum(n) // PAIRS
        cuts = np.flatnonzero(np.diff(piece)) + 1
        yield from np.split(np.arange(len(n)), cuts)

    def matches(self, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Window and start of exact occurrences; window and a start of each near match."""
        for rows in self.pieces() if len(self.numbers) and len(self.keys) else ():
            exact = self.kept(*self.starts_of(rows, 0), 0, np.zeros_like(self.allowed))
            parts = [
                self.starts_of(rows[(self.allowed[rows] >= k) & (self.lengths[rows] > k)], k)
                for k in range(int(self.allowed[rows].max()) + 1)
            ]
            row, start = self.distinct(np.concatenate([r for r, _ in parts]), np.concatenate([s for _, s in parts]))
            row, start = self.kept(row, start, 2 * slack, self.allowed)
            shifts = np.arange(-slack, slack + 1)
            row, start = self.distinct(
                np.repeat(row, len(shifts)), (start[:, None] + shifts[None, :]).reshape(-1)
            )
            row, start = self.kept(row, start, slack, self.allowed)
            # Runs of adjacent starts, in order of window and start.
            breaks = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])[:len(row)]
            whole = np.isin(row << 34 | start + GAP, exact[0] << 34 | exact[1] + GAP)
            holds = np.bincount(np.cumsum(breaks) - 1, whole, int(breaks.sum())) > 0
            first = np.flatnonzero(breaks)[~holds]
            yield self.numbers[exact[0]], exact[1], self.numbers[row[first]], start[first]

    @staticmethod
    def distinct(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A start may be a few words before the first document.
        pairs = np.unique(row << 34 | start + GAP)
        return pairs >> 34, (pairs & ((1 << 34) - 1)) - GAP


def _search_block(index: DataFrame, windows: DataFrame, width: int, slack: int) -> DataFrame:
    spark = index.sparkSession
    rows = windows.toArrow()
    runs = [run.split(b" ") for run in rows.column("run").to_pylist()]
    terms = sorted({t for run in runs for t in run})
    number = {t: i for i, t in enumerate(terms)}
    matrix = np.full((len(runs), width), -1, np.int64)
    for i, run in enumerate(runs):
        matrix[i, :len(run)] = [number[t] for t in run]
    lengths = np.array([len(run) for run in runs], np.int64)
    plan = spark.sparkContext.broadcast((terms, matrix, lengths, rows.column("items").to_pylist()))
    listed = spark.createDataFrame([(bytearray(t),) for t in [b"", *terms]], "term binary")
    searched = index.join(F.broadcast(listed), "term", "left_semi")

    def find(group: pa.Table) -> pa.Table:
        terms, matrix, lengths, of_window = plan.value
        number = {t: i for i, t in enumerate(terms)}
        lists: list[np.ndarray | None] = [None] * len(terms)
        directory = None
        for row in group.select(["shard", "term", "places", "doc_ids", "keys", "starts", "lengths"]).to_pylist():
            if row["term"] == b"":
                directory = row
            else:
                lists[number[row["term"]]] = np.frombuffer(row["places"], "<u4").astype(np.int64)
        starts = np.array(directory["starts"], np.int64)
        n = len(starts)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        found: list[set[str]] = [set() for _ in range(n)]
        near = np.zeros(n, np.int64)
        for window, start, _, close in ShardWindows(matrix, lengths, lists).matches(slack):
            at = np.searchsorted(starts, start, "right") - 1
            for doc, begin, which in zip(at.tolist(), (start - starts[at]).tolist(), window.tolist()):
                spans[doc].append((begin, begin + int(lengths[which])))
                found[doc].update(of_window[which])
            # A near match may begin before its document, by less than half of a gap.
            np.add.at(near, np.searchsorted(starts - GAP // 2, close, "right") - 1, 1)
        return pa.table(
            [pa.array([directory["shard"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
             pa.array(directory["doc_ids"], pa.int64()), pa.array(directory["keys"], pa.int64()),
             pa.array(directory["lengths"], pa.int64()),
             pa.array([sorted(f) for f in found], pa.list_(pa.string())),
             pa.array([[{"from": a, "to": b} for a, b in _merged(s)] for s in spans],
                      pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
             pa.array(near)],
            names=["shard", "place", "doc_id", "_key", "n_words", "items", "spans", "n_near"],
        )

    return searched.groupBy("shard").applyInArrow(find, FOUND)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def search(
    index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per indexed document its words, items found, hit spans (in words) and proximity matches.

    Columns: shard, place (in the shard), doc_id, _key, n_words, items, spans, n_near.
    """
    if 2 * (window + slack) >= GAP:
        raise ValueError(f"window and slack must be below {GAP // 2} words together")
    runs = window_rows(items, window)
    total = runs.agg(F.sum(F.size("items"))).first()[0] or 0
    n_blocks = max(-(-total // block_windows), 1)
    # Dealt by window, so that each is in one block and its matches are counted once.
    block = F.pmod(F.xxhash64("run"), F.lit(n_blocks))
    results = [
        _search_block(index, runs.filter(block == number), window, slack) for number in range(n_blocks)
    ]
    if len(results) == 1:
        return results[0]
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.groupBy("shard", "place", "doc_id", "_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sum("n_near").alias("n_near"),
    )


def hit_words(spans: str):
    """Words in any span."""
    inside = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"] - 1)))
    return F.size(F.array_distinct(inside)).cast("long")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold a passage of an item: (doc_id, _key, spans)."""

    def found() -> DataFrame:
        return search(positional_index(docs), items).filter(F.size("spans") > 0)

    return settled(docs.sparkSession, found, "contaminated").select("doc_id", "_key", "spans")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no passage of an item."""
    found = contaminated(docs, items).select("doc_id", "_key")
    return decided(docs, found, "left_anti", text_key())


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n_hit = hit_words("spans")
    return search(positional_index(docs), items).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "n_near",
    )


def _sql() -> str:
    """All windows of all texts compared as strings; proximity from every start, without anchors."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD_PATTERN}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {split} AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) <= {WINDOW} THEN [w]
    ELSE [w[i:i + {WINDOW - 1}] FOR i IN range(1, len(w) - {WINDOW - 2})] END) AS run
  FROM items WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT len(run) AS n FROM runs),
windows AS (
  SELECT r, i, n, w[i:i + n - 1] AS run
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths)
),
hits AS (SELECT r, i, n, item FROM windows JOIN runs USING (run)),
found AS (
  SELECT r, count(DISTINCT item) AS n_items,
    sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256
  FROM hits GROUP BY r
),
hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r
),
places AS (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM docs),
terms AS (
  SELECT run, len(run) AS n, unnest(run) AS term, unnest(range(1, len(run) + 1)) AS q
  FROM (SELECT DISTINCT run FROM runs)
),
possible AS (
  SELECT r, run FROM (SELECT DISTINCT r, term FROM places) JOIN terms USING (term)
  GROUP BY r, run HAVING count(*) >= any_value(n) - any_value(n) // 5
),
starts AS (
  SELECT r, run, s FROM (
    SELECT r, run, q, any_value(n) AS n, unnest(range(p - q - {SLACK}, p - q + {SLACK} + 1)) AS s
    FROM possible JOIN terms USING (run) JOIN places USING (r, term) GROUP BY r, run, q, p
  ) GROUP BY r, run, s HAVING count(DISTINCT q) >= any_value(n) - any_value(n) // 5
),
islands AS (
  SELECT r, run, s, s - row_number() OVER (PARTITION BY r, run ORDER BY s) AS island FROM starts
),
matches AS (
  SELECT r, run, island, bool_or(s >= 0 AND w[s + 1:s + len(run)] = run) AS exact
  FROM islands JOIN docs USING (r) GROUP BY r, run, island
),
near AS (SELECT r, count(*) AS n_near FROM matches WHERE NOT exact GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN found USING (r) LEFT JOIN hit USING (r) LEFT JOIN near USING (r)
"""


QUERIES = {"op1_contamination": op1_contamination}
CHECKS = {"op1_contamination": _sql()}
