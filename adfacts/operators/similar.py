"""All pairs of a vector and a label whose cosine is above a threshold, for many labels.

Labels are the stated set that every vector is held against. They are dealt to blocks of a fixed size,
each of which goes to all tasks; a task multiplies batches of vectors with a block. First only the
coordinates in which labels differ most are multiplied: what the others can add is at most the
product of both norms there, so a pair below the threshold with all of that is left out, and the rest of
the coordinates is multiplied for what remains. No pair is a row before it is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.session import pinned

# Labels of a block, pairs that a task looks at together, and those whose vectors it copies at once.
BLOCK = 4096
CELLS = 1 << 20
COPIED = 1 << 14


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one, and which of the lists they are; zeros and nulls have none."""
    known = np.array([v is not None and len(v) > 0 and None not in v for v in lists.to_pylist()], bool)
    rows = np.flatnonzero(known)
    if not len(rows):
        return np.zeros((0, 0)), rows
    matrix = np.array(lists.take(pa.array(rows)).to_pylist(), np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    kept = norms > 0
    return matrix[kept] / norms[kept, None], rows[kept]


def _close(vectors: np.ndarray, labels: np.ndarray, head: int, least: float) -> tuple[np.ndarray, ...]:
    """Rows, labels and cosines above ``least``; the first ``head`` coordinates are tried first."""
    tails = [np.linalg.norm(m[:, head:], axis=1) for m in (vectors, labels)]
    near = vectors[:, :head] @ labels[:, :head].T
    # A margin for what rounding may do.
    row, label = np.nonzero(near + tails[0][:, None] * tails[1][None, :] > least - 1e-9)
    cosine = near[row, label]
    if len(row) > near.size // 16:
        # Most of the work is left: all of it at once needs no copies of vectors.
        cosine += (vectors[:, head:] @ labels[:, head:].T)[row, label]
    else:
        for a in range(0, len(row), COPIED):
            of = slice(a, a + COPIED)
            cosine[of] += np.einsum("ij,ij->i", vectors[row[of], head:], labels[label[of], head:])
    kept = cosine > least
    return row[kept], label[kept], cosine[kept]


def cosine_pairs(
    df: DataFrame, key: str, vector: str, labels: DataFrame, label: str, label_vector: str, least: float,
) -> DataFrame:
    """(key, label, cosine) of every pair with a cosine above ``least``.

    Vectors are of one length; null, empty and zero vectors, and such with a null, are close to nothing.
    """
    spark = df.sparkSession
    kinds = df.schema[key].dataType.simpleString(), labels.schema[label].dataType.simpleString()
    listed = labels.select(F.col(label).alias("_label"), F.col(label_vector).alias("_vector"))
    n_blocks = max(-(-listed.count() // BLOCK), 1)
    dealt = pinned(listed.withColumn("_block", F.pmod(F.xxhash64("_label", "_vector"), F.lit(n_blocks))))
    found = None
    for number in range(n_blocks):
        block = dealt.filter(F.col("_block") == number).toArrow()
        units, rows = _units(block.column("_vector").combine_chunks())
        # Coordinates in which labels differ most come first.
        order = np.argsort(-units.var(0)) if len(units) else np.zeros(0, int)
        shared = spark.sparkContext.broadcast(
            (units[:, order], order, block.column("_label").combine_chunks().take(pa.array(rows)))
        )

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of_label, order, names = shared.value
            for batch in batches:
                vectors, rows = _units(batch.column(1))
                if not len(vectors) or not len(of_label):
                    continue
                step = max(CELLS // len(of_label), 1)
                for start in range(0, len(vectors), step):
                    part = vectors[start:start + step][:, order]
                    row, which, cosine = _close(part, of_label, max(len(order) // 4, 1), least)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[start + row])), names.take(pa.array(which)),
                         pa.array(cosine)],
                        names=["key", "label", "cosine"],
                    )

        part = df.select(key, vector).mapInArrow(match, f"key {kinds[0]}, label {kinds[1]}, cosine double")
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"key": key, "label": label})
