"""Records of CSV files whose fields span lines, read by split.

A file is read as lines, so it is split like any text file: a line belongs to the split in which it
begins. A line end inside a quoted field has an odd number of quotes before it in its file. Three
steps, none of which moves text between tasks but for records that cross the end of a split:

1. Quotes are counted per split. Their sums over the splits before say which splits begin inside
   a field; that is one row of two numbers per split.
2. Each split is read again with that knowledge, and its lines are put together to records, a batch
   of lines at a time.
3. What is left at the ends of splits (the end of a record that began before, the begin of one
   that ends behind, or a split within one record) is put together by file.

Quotes must be those of quoted fields, doubled inside of them, as ``write_csv`` and RFC 4180 have
them. A file whose quotes are not paired is an error, and so is a record over lines none of whose
fields begins with a quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adfacts.session import pinned

# What a piece of text is: a record, the end of one that began before its split, the begin of one,
# or a whole split within one.
WHOLE, END, BEGIN, INSIDE = range(4)
PIECE = "file string, start long, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, text, odd): lines in order within each split that begins at ``start``.

    Only line feeds end a line; a carriage return before one stays with it.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("text"), (quotes % 2).cast("int").alias("odd"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """(key, open): whether a split begins inside a field. A row of two numbers per split."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "start").agg(F.sum("odd").alias("odd"))
    last = F.sum("odd").over(Window.partitionBy("file"))
    error = F.raise_error(F.concat(F.lit("quotes are not paired in "), F.col("file")))
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    begins = F.when(last % 2 == 0, inside).otherwise(error.cast("boolean"))
    return pinned(sums.select(F.xxhash64("file", "start").alias("key"), begins.alias("open")))


def _joined(texts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Runs of texts up to each end (exclusive), with line feeds between."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), texts)
    return pc.binary_join(lists, pa.scalar("\n", texts.type))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits to pieces; see ``PIECE``. Lines come as (file, start, text, odd, open)."""
    file = start = None
    held: list[str] = []
    inside = opened = ended = False
    # A file's first text that is not blank is still to come.
    awaited = False

    def rows(texts: pa.Array, kinds: list[int]) -> pa.RecordBatch:
        nonlocal awaited
        n, first = len(texts), -1
        if awaited:
            first = next((i for i, t in enumerate(texts) if t.as_py().strip("\r")), -1)
            awaited = first < 0
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()),
             pa.array(kinds, pa.int32()), pa.array(np.arange(n) == first), texts],
            names=["file", "start", "kind", "first", "text"],
        )

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            kind = INSIDE if opened and not ended else BEGIN if inside else WHOLE
            yield rows(pa.array(["\n".join(held)], pa.string()), [kind])

    for batch in batches:
        names = batch.column("file").dictionary_encode().indices.to_numpy()
        starts = batch.column("start").to_numpy()
        changes = np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *changes], [*changes, batch.num_rows]):
            part = batch.slice(a, b - a)
            here = part.column("file")[0].as_py(), part.column("start")[0].as_py()
            if here != (file, start):
                yield from rest()
                (file, start), held, ended = here, [], False
                awaited = start == 0
                inside = opened = part.column("open")[0].as_py()
            # Whether each line ends inside a field.
            state = (np.cumsum(part.column("odd").to_numpy()) + inside) % 2
            texts = pa.concat_arrays([pa.array(held, pa.string()), part.column("text").cast(pa.string())])
            ends = np.flatnonzero(state == 0) + 1 + len(held)
            if len(ends):
                done = _joined(texts.slice(0, ends[-1]), ends)
                kinds = [END if opened and not ended else WHOLE] + [WHOLE] * (len(done) - 1)
                yield rows(done, kinds)
                held, ended = texts.slice(ends[-1]).to_pylist(), True
            else:
                held = texts.to_pylist()
            inside = bool(state[-1])
    yield from rest()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): records as they stand; ``first`` marks the first text of a file."""
    lines = _lines(spark, path)
    splits = _splits(lines)
    # Sixteen bytes per split: a hundred terabytes in splits of 128 MB are 13 MB.
    known = lines.join(
        F.broadcast(splits), F.xxhash64("file", "start") == F.col("key"), "left"
    ).select("file", "start", "text", "odd", "open")
    pieces = known.mapInArrow(_pieces, PIECE)
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", "text")
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGIN)
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn(
        "number", F.count(F.when(F.col("kind") == BEGIN, 1)).over(order)
    )
    stitched = parts.groupBy("file", "number").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "text")))["text"].alias("_texts"),
    ).select("file", "first", F.array_join("_texts", "\n").alias("text"))
    return whole.unionByName(stitched)


def parsed(records: DataFrame, header: StructType, names: list[str], options: dict) -> DataFrame:
    """Columns ``names`` from records; in the first record of each file they must be the header's."""
    text = F.regexp_replace("text", r"\r$", "")
    text = F.when(F.col("first"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    loose = F.contains("text", F.lit("\n")) & ~F.col("text").rlike('(?:^|,)"')
    error = F.raise_error(F.concat(F.lit("a quote outside of a quoted field in "), F.col("file")))
    quoted = {"`": "``"}
    ddl = ", ".join(f"`{f.name.translate(str.maketrans(quoted))}` string" for f in header)
    given = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    fields = F.from_csv(
        F.when(loose, error.cast("string")).otherwise(text), ddl,
        {**given, "header": "false", "multiLine": "true"},
    )
    # Generated, so that a record is parsed once, whatever is read of it.
    rows = records.filter(F.length(text) > 0).select("file", "first", F.explode(F.array(fields)).alias("_r"))
    same = F.lit(True)
    for name in names:
        same = same & F.col("_r")[name].eqNullSafe(F.lit(name))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("file")))
    kept = F.when(~F.col("first"), F.lit(True)).when(same, F.lit(False)).otherwise(other.cast("boolean"))
    return rows.filter(kept).select(*[F.col("_r")[name].alias(name) for name in names])
