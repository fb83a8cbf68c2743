"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies between ``LOW`` and ``HIGH``, a band of
inverse document frequency. Its size has a bound whatever the corpus: shares of all terms sum up
to the mean number of distinct terms of a document, so at most that over ``LOW`` terms reach it.

A fingerprint has a hash of all lexicon terms of the text, sorted, and hashes of its terms in
randomised subsets of the lexicon: ``SUBSETS`` subsets at each of three rates, each half the one
before, from one expected term per subset downwards, so that an edit breaks about as large a part
of them as it changes of the terms. The likeness of two fingerprints is the share of equal hashes among the subsets of common
rates that hold a term of either text; 1 if the hashes of all terms are equal.

For edits, documents are dealt to ranges of ids of equal size, and the first of each range goes
to the one before as well: whoever sorts a range has the next document of each. Texts move once.

Defined results: a null text is empty; equal texts have equal fingerprints; a text with fewer
than ``LEAST_TERMS`` terms in the band uses all its terms, one without words its characters;
documents with equal ids follow each other by text, and the lowest text comes after the document
before; null ids come first; the last is followed by the first, a single one by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import table, words

LOW, HIGH = 2e-4, 0.1
SUBSETS = 32
LEAST_TERMS = 8
# Terms of which all subsets are hashed at once.
PIECE = 1 << 16
SEEDS = np.array(
    [xxhash.xxh64_intdigest(b"subset %d" % i) for i in range(SUBSETS)], np.uint64
)
FIRST = -(1 << 63)

SCHEMA = (
    "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def term_hashes(text: str) -> np.ndarray:
    """Sorted hashes of the distinct terms of a text."""
    found = set(words(text.encode()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    hashes.sort()
    return hashes


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): hashed terms and in how many documents they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [term_hashes(t.as_py()) for t in batch.column(0) if t.is_valid]
            if not hashes:
                continue
            kinds, numbers = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(numbers)], names=["term", "n"]
            )

    return (
        docs.select("text").mapInArrow(count, "term long, n long")
        .groupBy("term").agg(F.sum("n").alias("n"))
    )


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    band = document_frequencies(docs).filter(F.col("n").between(low * n, high * n))
    terms = band.select("term").toArrow().column(0).to_numpy()
    return np.sort(terms.view(np.uint64))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def signatures(terms: np.ndarray) -> dict[int, list[int]]:
    """Per rate (as a power of one half) the 16-bit hashes of the subsets; 0 for an empty one."""
    middle = max(round(float(np.log2(len(terms)))), 0)
    levels = range(middle, middle + 3)
    parts = []
    for start in range(0, len(terms), PIECE):
        piece = terms[start:start + PIECE]
        drawn = _mixed(SEEDS[:, None] ^ piece)
        # Members at the highest rate; those at the others are among them.
        subset, at = np.nonzero((drawn & _low_bits(middle)) == 0)
        parts.append((subset, piece[at], drawn[subset, at]))
    subset, members, drawn = (np.concatenate(p) for p in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(subset, kind="stable")
        subset, members, drawn = subset[order], members[order], drawn[order]
    found = {}
    for level in levels:
        chosen = (drawn & _low_bits(level)) == 0
        data = members[chosen].tobytes()
        ends = (8 * np.searchsorted(subset[chosen], np.arange(SUBSETS + 1))).tolist()
        found[level] = [
            xxhash.xxh32_intdigest(data[i:j]) % 65535 + 1 if j > i else 0
            for i, j in zip(ends, ends[1:])
        ]
    return found


def _low_bits(level: int) -> np.uint64:
    return np.uint64((1 << level) - 1)


def fingerprint(text: str, band: np.ndarray) -> str:
    """``all terms:rate.subset hashes:...`` in hexadecimal."""
    terms = term_hashes(text)
    if len(band):
        at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
        inside = terms[band[at] == terms]
        if len(inside) >= LEAST_TERMS:
            terms = inside
    if not len(terms):
        terms = np.array([xxhash.xxh64_intdigest(b"text " + text.encode())], np.uint64)
    parts = [f"{level:02x}." + "".join(f"{s:04x}" for s in hashes)
             for level, hashes in signatures(terms).items()]
    return ":".join([f"{xxhash.xxh64_intdigest(terms.tobytes()):016x}", *parts])


def likeness(a: str, b: str) -> float:
    """Share of equal subsets of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (whole, *left), (other, *right) = a.split(":"), b.split(":")
    if whole == other:
        return 1.0
    of_level = dict(part.split(".") for part in right)
    equal = either = 0
    for level, hashes in (part.split(".") for part in left):
        if level in of_level:
            theirs = of_level[level]
            for i in range(0, 4 * SUBSETS, 4):
                x, y = hashes[i:i + 4], theirs[i:i + 4]
                if x != "0000" or y != "0000":
                    either += 1
                    equal += x == y
    return equal / either if either else 0.0


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, _range, _last) sorted within ranges; ``_last`` only follows the others."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    steps = [i / ranges for i in range(1, ranges)]
    found = docs.agg(
        F.min(key).alias("least"),
        F.percentile_approx(key, steps, 50 * ranges).alias("bounds") if steps else F.lit(None).alias("bounds"),
    ).first()
    bounds = sorted(set(found["bounds"] or []))
    listed = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<long>")
    own = F.size(F.filter(listed, lambda b: b <= F.col("_id")))
    # The first of a range follows the last of the range before, the very first the very last.
    before = F.when(F.col("_id") == F.lit(found["least"]), F.lit(len(bounds))).when(
        F.array_contains(listed, F.col("_id")), own - 1
    )
    first_too = F.when(
        (F.col("_id") == F.lit(found["least"])) & F.array_contains(listed, F.col("_id")), own - 1
    )
    places = F.array_compact(F.array(
        F.struct(own.alias("range"), F.lit(False).alias("last")),
        F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(True).alias("last"))),
        F.when(first_too.isNotNull(), F.struct(first_too.alias("range"), F.lit(True).alias("last"))),
    ))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_id"))
        .withColumn("_place", F.explode(places))
        .select("doc_id", "text", "_id", F.col("_place.range").alias("_range"), F.col("_place.last").alias("_last"))
        .repartitionById(len(bounds) + 1, F.col("_range"))
        .sortWithinPartitions("_range", "_last", "_id", "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness."""
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(lexicon(docs))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for doc_id, text, place, last in zip(*(batch.column(c) for c in ("doc_id", "text", "_range", "_last"))):
                text, place, last = text.as_py(), place.as_py(), last.as_py()
                mark = fingerprint(text, band.value)
                if before is not None and before[2] == place:
                    rows.append(_compared(before, text, mark, band.value))
                # Only the first of those that follow a range counts.
                before = None if last else (doc_id.as_py(), text, place, mark)
            columns = list(zip(*rows)) or [()] * 7
            types = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, ranges).mapInArrow(compare, SCHEMA.format(kind))


def _compared(row: tuple, following: str, its_mark: str, band: np.ndarray) -> tuple:
    doc_id, text, _, mark = row
    cut = len(text) // 4
    edited = text[:len(text) - cut] + following[:cut]
    edited_mark = fingerprint(edited, band)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark,
        likeness(mark, edited_mark), likeness(mark, its_mark),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
CHECKS: dict[str, str] = {}
