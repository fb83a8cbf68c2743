"""Near copies by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of ``SHINGLE`` words, each labelled with its occurrence, so
that labels are unique in a text. A sketch draws the ``ORDERED`` lowest labels under each of
``SKETCHES`` hash functions and keeps them in text order: two texts agree in one if they share
these labels and their order, with a chance of about the similarity to the power of ``ORDERED``;
at 0.8, of 20 sketches one agrees but for 4 in 10,000 pairs. Texts of up to ``SHORT`` runs also
draw ``ORDERED_SHORT`` labels, those of fewer than ``LONG`` only those: any two texts as similar as
0.8 have a kind of sketch in common.

The similarity of two texts is the longest common subsequence of labels over the labels of
both, the order-sensitive Jaccard. At ``SIMILARITY`` it limits how far an alignment may leave the
diagonal; labels that meet beyond that band are left out. It also limits how many labels only one
of two texts may have, and the bits in which the parity bitmaps of two texts differ are never
more than these: pairs over the limit are left out before any text is read, and none is lost.

Exact copies are one text from the start. Texts with an equal sketch are a bucket. A bucket
elects as hub the text that shares most buckets with others and compares its members to it; those
of another class than the hub elect the next, as long as a round links one text in a hundred.
What is left are pairs in a bucket whose texts are not yet known to be of one class. In buckets of up to
``PAIRED`` texts all of those within the limits above are compared. Texts of larger ones, as share a
long passage and little else, are paired by an exact prefix filter: of two texts as similar as
asked for, one of the rarest labels of each, as many as may be missing and one more, is in the other, and
labels that one text alone has pair nothing. So a bucket of thousands costs a comparison per member, not
all pairs, and no pair of a bucket that could join two classes is left out. Connected components
of the verified links are the classes.

Every step is a shuffle by text, bucket or class: texts of pairs are joined and streamed, none is
gathered. Joins of hot buckets, hubs and classes are inner or left joins that Spark splits.

Defined results: a null text is empty; texts without a word are alone but for exact copies; texts
of fewer words than a run are one run; the class is named by its lowest id (null if it has no
id), and the lowest id, and of equal ids one row, stays.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import OWN, decided, settled, table, words, written

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, ORDERED = 20, 5
SKETCHES_SHORT, ORDERED_SHORT = 16, 3
SHORT, LONG = 20, 16
PIECE = 1 << 15
# Texts of a bucket all of whose pairs may be compared: a text is in few buckets, so what this costs a
# text has a bound, whatever the corpus.
PAIRED = 4096

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.array(
    [xxhash.xxh64_intdigest(b"sketch %d" % i) for i in range(SKETCHES + SKETCHES_SHORT)], np.uint64
)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _folded(rows: np.ndarray) -> np.ndarray:
    """One hash per row of a matrix, of its values in order."""
    total = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        total = _mixed(total * MULTIPLIER + rows[:, i])
    return total


def labels(text: bytes | None) -> np.ndarray:
    """Occurrence-labelled hashes of the runs of words, in text order."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if len(hashes) >= SHINGLE:
        hashes = np.lib.stride_tricks.sliding_window_view(hashes, SHINGLE)
    else:
        hashes = hashes[None, :]
    runs = _folded(hashes)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if begins.all():
        return runs
    at = np.arange(len(runs))
    occurrence = np.empty(len(runs), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, _mixed(runs + occurrence * MULTIPLIER), runs)


def _drawn(found: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Per seed the hash of the ``size`` lowest labels in text order."""
    size = min(size, len(found))
    best = None
    for start in range(0, len(found), PIECE):
        values = _mixed(found[None, start:start + PIECE] ^ seeds[:, None])
        n = min(size, values.shape[1])
        at = np.argpartition(values, n - 1, axis=1)[:, :n]
        part = (np.take_along_axis(values, at, 1), at + start)
        best = part if best is None else tuple(np.concatenate(p, 1) for p in zip(best, part))
        if best[0].shape[1] > size:
            at = np.argpartition(best[0], size - 1, axis=1)[:, :size]
            best = tuple(np.take_along_axis(b, at, 1) for b in best)
    places = np.sort(best[1], axis=1)
    return _mixed(_folded(found[places]) ^ seeds)


def sketches(found: np.ndarray) -> np.ndarray:
    """All sketches of a text; each hash function has hashes of its own."""
    parts = [np.zeros(0, np.uint64)]
    if len(found) >= LONG:
        parts.append(_drawn(found, SEEDS[:SKETCHES], ORDERED))
    if 0 < len(found) <= SHORT:
        parts.append(_drawn(found, SEEDS[SKETCHES:], ORDERED_SHORT))
    return np.concatenate(parts)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-sensitive Jaccard of two label sequences; 0 if it cannot reach ``least``."""
    both = len(a) + len(b)
    need = math.ceil(both * least / (1 + least) - 1e-9)
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return 0.0
    band = both - 2 * need
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    places = order[at]
    places = places[(b[places] == a) & (np.abs(places - np.arange(len(a))) <= band)]
    if len(places) < need:
        return 0.0
    if (places[1:] > places[:-1]).all():
        common = len(places)
    else:
        ends: list[int] = []
        for place in places.tolist():
            i = bisect.bisect_left(ends, place)
            if i == len(ends):
                ends.append(place)
            else:
                ends[i] = place
        common = len(ends)
    return common / (both - common) if common >= need else 0.0


def parity(found: np.ndarray) -> np.ndarray:
    """Bitmap of at least two bits per label: which bits an odd number of labels hash to.

    Its size is a power of two, so that a larger one folds onto a smaller one.
    """
    size = 64
    while size < 2 * len(found):
        size *= 2
    odd = np.bincount((found >> np.uint64(17)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def copy_key() -> Column:
    """What exact copies have in common."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n, sketches, bits) of every document, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labels(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([sketches(f).view(np.int64) for f in found], longs),
                 pa.array([parity(f) for f in found], longs)],
                names=["doc_id", "copy", "n", "sketches", "bits"],
            )

    read = docs.select("doc_id", copy_key().alias("copy"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind}, copy binary, n long, sketches array<long>, bits array<long>"
    return written(read.mapInArrow(sketch, schema), "sketches")


def _within(bits: str, n: str, other_bits: str, other_n: str, least: float) -> Column:
    """Whether two texts could be as similar as ``least``, by their sizes and bitmaps."""
    a, b = F.col(bits), F.col(other_bits)
    both = F.col(n) + F.col(other_n)

    def folded(x: Column, size: Column) -> Column:
        halves = F.zip_with(
            F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q)
        )
        return F.when(F.size(x) > size, halves).otherwise(x)

    size = F.least(F.size(a), F.size(b))
    apart = F.aggregate(
        F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
        F.lit(0), lambda total, x: total + x,
    )
    # Sizes in this ratio have bitmaps of the same size or of the double.
    close = F.least(n, other_n) >= F.greatest(n, other_n) * least - 1e-9
    return close & (apart <= both * (1 - 2 * least / (1 + least)) + 1e-9)


def _weighted(reps: DataFrame) -> DataFrame:
    """(bucket, copy, n, bits, weight) of buckets with several texts; weight is what a text shares."""
    rows = reps.select("copy", F.explode("sketches").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    # Written, so that the join deals both sides anew and Spark may split a hot bucket.
    shared = written(sizes.filter(F.col("_size") > 1), "shared")
    members = written(rows.join(shared, "bucket"), "members")
    weights = members.groupBy("copy").agg(F.sum("_size").alias("weight"))
    of_text = weights.join(reps.select("copy", "n", "bits"), "copy")
    return written(members.drop("_size").join(of_text, "copy"), "weighted")


def _to_hubs(members: DataFrame) -> DataFrame:
    """Members with the heaviest text of their bucket."""
    hubs = members.groupBy("bucket").agg(
        F.max(F.struct("weight", "copy", "n", "bits")).alias("_hub")
    ).select(
        "bucket", F.col("_hub.copy").alias("hub"), F.col("_hub.n").alias("hub_n"),
        F.col("_hub.bits").alias("hub_bits"), F.col("_hub.weight").alias("hub_weight"),
    )
    return members.join(written(hubs, "hubs"), "bucket").filter(F.col("copy") != F.col("hub"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """(copy, label): texts of one label are known to be of one class.

    A text takes the heaviest hub it is linked to, if heavier than itself, and its label.
    """
    own = members.select("copy", "weight").distinct()
    hubs = links.groupBy("copy").agg(F.max(F.struct("hub_weight", "hub")).alias("_hub"))
    heavier = F.struct("hub_weight", "hub") > F.struct("weight", "copy")
    first = written(
        own.join(hubs, "copy", "left").select("copy", "weight", "_hub.*").select(
            "copy", F.when(heavier, F.col("hub")).otherwise(F.col("copy")).alias("label")
        ),
        "labels",
    )
    of_label = first.select(F.col("copy").alias("label"), F.col("label").alias("_next"))
    return written(first.join(of_label, "label").select("copy", F.col("_next").alias("label")), "labels")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(copy, hub, hub_weight) of the pairs that are similar."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_hub = None, None
        for batch in batches:
            keep = []
            for hub, text, other in zip(*(batch.column(c) for c in ("hub", "text", "hub_text"))):
                if hub.as_py() != last:
                    last, of_hub = hub.as_py(), labels(other.as_py())
                keep.append(similarity(labels(text.as_py()), of_hub, least) >= least)
            yield batch.select(["copy", "hub", "hub_weight"]).filter(pa.array(keep, pa.bool_()))

    of_hub = texts.select(F.col("copy").alias("hub"), F.col("text").alias("hub_text"))
    both = pairs.join(texts, "copy").join(of_hub, "hub")
    return written(
        both.select("copy", "hub", "hub_weight", "text", "hub_text").mapInArrow(
            align, "copy binary, hub binary, hub_weight long"
        ),
        "links",
    )


def similar_links(docs: DataFrame, reps: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(copy, hub): verified links between different texts that hold the classes together.

    ``reps`` has copy, n, sketches and bits of every different text.
    """
    members = _weighted(reps)
    involved = members.select("copy").distinct()
    texts = written(
        docs.select(copy_key().alias("copy"), F.col("text").cast("binary").alias("text"))
        .groupBy("copy").agg(F.first("text").alias("text"))
        .join(involved, "copy", "left_semi"),
        "texts",
    )
    n_texts = texts.count()
    within = _within("bits", "n", "hub_bits", "hub_n", least)
    ends = ["copy", "hub", "hub_weight"]
    open_members, links = members, None
    while True:
        compared = _to_hubs(open_members)
        found = _verified(compared.filter(within).select(*ends).distinct(), texts, least)
        links = found if links is None else links.unionByName(found)
        labels_now = _labelled(members, links)
        if found.count() * 100 <= n_texts:
            break
        hub_labels = labels_now.withColumnsRenamed({"copy": "hub", "label": "hub_label"})
        open_members = written(
            compared.join(labels_now, "copy").join(hub_labels, "hub")
            .filter(F.col("label") != F.col("hub_label")).select(*members.columns),
            "open",
        )
    left = members.join(labels_now, "copy")
    ends_of = left.groupBy("bucket").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("_size")
    )
    mixed = written(ends_of.filter("a != b").select("bucket", "_size"), "mixed")
    left = written(left.join(mixed, "bucket"), "left")
    small = _paired(left.filter(F.col("_size") <= PAIRED), "bucket", within)
    large = left.filter(F.col("_size") > PAIRED).select("copy", "n", "bits", "weight", "label").distinct()
    sharing = _rare_labels(written(large, "large"), texts, least)
    rest = small.unionByName(_paired(sharing, "shingle", within))
    return links.unionByName(_verified(rest.distinct(), texts, least))


def _paired(rows: DataFrame, key: str, within: Column) -> DataFrame:
    """(copy, hub, hub_weight) of rows with equal ``key`` and other labels that are ``within``."""
    other = rows.select(
        F.col(key).alias("_key"), F.col("copy").alias("hub"), F.col("n").alias("hub_n"),
        F.col("bits").alias("hub_bits"), F.col("weight").alias("hub_weight"),
        F.col("label").alias("hub_label"),
    )
    both = rows.join(
        other,
        (F.col(key) == F.col("_key")) & (F.col("copy") < F.col("hub"))
        & (F.col("label") != F.col("hub_label")) & within,
    )
    return both.select("copy", "hub", "hub_weight")


def _rare_labels(large: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``large`` (copy, n, bits, weight, label) with each ``shingle`` of the prefix of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labels(text.as_py()).view(np.int64) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("copy"), pa.array(found, pa.list_(pa.int64()))], names=["copy", "shingles"]
            )

    read = texts.join(large.select("copy"), "copy", "left_semi").select("copy", "text")
    every = written(read.mapInArrow(cut, "copy binary, shingles array<long>"), "shingles")
    rows = every.select("copy", F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").count().filter(F.col("count") > 1)
    several = rows.join(written(counts, "counts"), "shingle")
    # The partner with the fewest shingles asks for the least in common: n times ``least``.
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    # Those that one text alone has are the rarest.
    kept = (prefix - (F.col("n") - F.size("_several"))).cast("int")
    return (
        several.groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("_several"))
        .join(large, "copy")
        .filter(kept > 0)
        .withColumn("shingle", F.explode(F.slice("_several", F.lit(1), kept)["shingle"]))
        .drop("_several")
    )


def components(links: DataFrame) -> DataFrame:
    """(copy, root): the lowest text each linked text is connected to.

    Large and small stars by turns: every text is linked to the lowest it knows of, until all
    links are stars.
    """
    edges = written(links.select(F.col("copy").alias("a"), F.col("hub").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join deals both sides anew and Spark may split a hub.
        lowest = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
        large = (
            both.filter(F.col("b") > F.col("a")).join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = written(large, "large")
        # All links now go from a text to a lower one.
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        ends = F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        small = large.join(lowest, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b")
        edges = written(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        # Done when no text that others are linked to is linked on itself.
        if edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("copy"), F.col("b").alias("root"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy, class_id, stays): one row per document.

    ``stays`` marks the documents of the lowest id of a class, and of these one text.
    """
    return settled(docs.sparkSession, lambda: _classes(docs, least), "classes")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    rows = sketched(docs)
    reps = rows.groupBy("copy").agg(
        *[F.first(c).alias(c) for c in ("n", "sketches", "bits")], F.min("doc_id").alias("_low")
    )
    reps = written(reps, "reps")
    found = components(similar_links(docs, reps, least))
    texts = reps.select("copy", "_low").join(found, "copy", "left").withColumn(
        "root", F.coalesce("root", "copy")
    )
    texts = written(texts, "roots")
    first = F.struct(F.col("_low").isNull(), F.col("_low"), F.col("copy"))
    lowest = written(
        texts.groupBy("root").agg(F.min(first).alias("_first")).select(
            "root", F.col("_first._low").alias("class_id"), F.col("_first.copy").alias("_stays")
        ),
        "lowest",
    )
    named = texts.join(lowest, "root").select("copy", "class_id", "_stays")
    return rows.select("doc_id", "copy").join(named, "copy").select(
        "doc_id", "copy", "class_id",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("_stays"))).alias("stays"),
    )


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class of near copies."""
    kept = classes(docs, least).filter("stays").select("doc_id", "copy")
    key = f"{OWN}copy"
    return (
        decided(docs.withColumn(key, copy_key()), kept, "left_semi", F.col(key))
        .dropDuplicates(["doc_id", key]).drop(key)
    )


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "stays")


QUERIES = {"op4_near_copies": op4_near_copies}
CHECKS: dict[str, str] = {}
