"""Group-wise work that stays balanced when one group holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts.session import pinned

# A key with more than one in so many rows is hot.
SHARES = 1000


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]
) -> DataFrame:
    """For each row the sum of each total over the earlier rows of its group.

    ``order`` must end in a unique column. The table is range-partitioned by group and
    order, so a large group spans many slices; each slice then starts from the sum of the
    slices before it. No task holds more of a group than one slice of the whole table.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = [F.col(k) for k in keys] + order
    sliced = pinned(
        df.withColumns(totals)
        .repartitionByRange(slices, *ranges)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = (Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "_slice").agg(*[F.sum(t).alias(t) for t in totals])
    slice_order = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*earlier)
    starts = sums.select(
        *keys,
        "_slice",
        F.lit(False).alias("_row"),
        *[F.coalesce(F.sum(t).over(slice_order), F.lit(0)).alias(t) for t in totals],
    )
    # The start of a slice enters as a row in front of it and leaves after the sum.
    rows = sliced.withColumn("_row", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    row_order = Window.partitionBy(*keys, "_slice").orderBy("_row", *order).rowsBetween(*earlier)
    return (
        rows.withColumns({t: F.sum(t).over(row_order) for t in totals})
        .filter("_row")
        .drop("_row", "_slice")
    )


def _same(df: DataFrame, values: DataFrame, keys: list[str]) -> Column:
    """Equal in all keys, the second table's under ``_of_`` names; a null equals a null."""
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(values[f"_of_{k}"])
    return match


def _renamed(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def group_join(
    df: DataFrame, values: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join one row of values per key; a null key finds the values of the null key.

    Spark picks the plan by the sizes it meets: a broadcast, or a shuffle in which it splits
    the rows of a hot key. An aggregate over the same keys behind it forbids that split; see
    ``spread_join``.
    """
    values = _renamed(values, keys)
    return df.join(values, _same(df, values, keys), how).drop(*[f"_of_{k}" for k in keys])


def spread_join(
    df: DataFrame, values: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """``group_join`` for what is grouped by the same keys next.

    Keys with more than one in ``SHARES`` of all rows are hot; there can be no more than
    ``SHARES`` of them, so their list is broadcast. Their rows go to as many parts as they
    hold such shares, and only their values are copied. ``df`` is read twice.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    shares = F.ceil(F.col("_rows") * SHARES / total).cast("int")
    hot = F.broadcast(
        _renamed(counts.filter(F.col("_rows") * SHARES > total), keys).select(
            *[f"_of_{k}" for k in keys], shares.alias("_parts")
        )
    )
    parts = F.coalesce("_parts", F.lit(1))
    dealt = group_parts(df, hot, keys).withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    )
    copies = _renamed(
        group_parts(values, hot, keys)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts"),
        keys,
    )
    match = _same(dealt, copies, keys) & (F.col("_salt") == F.col("_copy"))
    dropped = ["_salt", "_copy", "_parts", *[f"_of_{k}" for k in keys]]
    return dealt.join(copies, match, how).drop(*dropped)


def group_parts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``_parts`` of their key, null unless it is hot."""
    return df.join(hot, _same(df, hot, keys), "left").drop(*[f"_of_{k}" for k in keys])
