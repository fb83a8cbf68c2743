"""Values as of a time: each row takes the latest value of its key that is not after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfacts.operators.slices import carried, sliced, with_carried, within


def as_of(
    df: DataFrame, values: DataFrame, key: str, time: str, of_time: str, columns: list[str]
) -> DataFrame:
    """``df`` with ``columns`` and ``of_time`` of the value that was valid at ``time``.

    Both sides are put in one order of key and time, a value before a row of the same time, and the last
    value seen is carried on, over the ends of slices as well; so neither side of a hot key is in
    one task. Of several values of one time the last by ``columns`` counts. Rows without a key or a
    time, and those before the first value, get nulls; values without either are not read.
    """
    value = F.struct(of_time, *columns)
    left = df.select(
        F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(1).alias("_side"),
        F.struct(*df.columns).alias("_row"), F.lit(None).cast(values.select(value.alias("v")).schema["v"].dataType).alias("_value"),
    )
    known = values.filter(F.col(key).isNotNull() & F.col(of_time).isNotNull())
    right = known.select(
        F.col(key).alias("_key"), F.col(of_time).alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), value.alias("_value"),
    )
    # The hash deals rows of one key and time over several slices.
    both = left.unionByName(right).withColumn("_tie", F.xxhash64("_row"))
    rows = sliced(both, ["_key"], ["_at", "_side", "_tie"])
    last = F.last("_value", ignorenulls=True)
    upto = within(["_key"], ["_at", "_side", "_value", "_tie"]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # A slice's last value by the same order.
    ends = rows.groupBy("_key", "_slice").agg(
        F.max(F.when(F.col("_side") == 0, F.struct("_at", "_value")))["_value"].alias("_value")
    )
    over = carried(ends, ["_key"], {"_before": last})
    found = F.coalesce(F.col("_here"), F.col("_before"))
    known_time = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return (
        with_carried(rows.withColumn("_here", last.over(upto)), over, ["_key"])
        .filter(F.col("_side") == 1)
        .select("_row.*", F.when(known_time, found).alias("_found"))
        .select(*df.columns, *[F.col(f"_found.{c}").alias(c) for c in (of_time, *columns)])
    )
