"""Ordered work over groups of any size: slices of one order, and what goes over their ends.

A table is range-partitioned by key and order, so a key with a third of all rows spans many slices.
Each slice is worked on by itself; what it needs of the slices before or behind it is one row per
slice end, as only one key can go over each. So the table of what goes over has fewer rows than there
are slices, and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from adfacts.session import pinned

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, written once, with their slice of the order by ``keys`` and ``order``."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pinned(
        df.repartitionByRange(slices, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    )


def within(keys: list[str], order: list[Column | str]) -> WindowSpec:
    """Rows of a key within a slice, in order."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def carried(
    ends: DataFrame, keys: list[str], values: dict[str, Column], back: bool = False
) -> DataFrame:
    """Per key and slice the values that come over its end.

    ``ends`` has a row per key and slice. Each value is an expression over the rows of the key in
    earlier slices (later ones with ``back``), nearest last. Keys of one slice get no row.
    """
    order = F.desc(SLICE) if back else F.col(SLICE)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = {name: value.over(before) for name, value in values.items()}
    found = ends.withColumn("_n", F.count(F.lit(1)).over(before)).withColumns(over)
    return found.filter(F.col("_n") > 0).select(*keys, SLICE, *values)


def with_carried(rows: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what comes over the end of their slice, null where nothing does."""
    names = {k: f"_of{k}" for k in [*keys, SLICE]}
    over = F.broadcast(over.withColumnsRenamed(names))
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(over[n]) for k, n in names.items()])
    return rows.join(over, match, "left").drop(*names.values())
