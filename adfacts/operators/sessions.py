"""Sessions of events by key: runs of events no further apart than a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts.operators.slices import carried, sliced, with_carried, within


def with_sessions(df: DataFrame, key: str, time: str, gap: int, tie: str) -> DataFrame:
    """``df`` with ``session``, numbered per key from 1; ``gap`` is in microseconds.

    A session begins where an event comes more than ``gap`` after the one before it. Begins are found
    and counted within slices of the order of key, time and ``tie``, a unique column; the last time and
    the number of begins of earlier slices come over their ends, so one user's events need not be
    in one task. Events without a time are not read; those without a key are one key's.
    """
    at = F.unix_micros(time) if dict(df.dtypes)[time] == "timestamp" else F.col(time).cast("long")
    rows = sliced(df.withColumn("_at", at).filter(F.col("_at").isNotNull()), [key], ["_at", tie])
    order = within([key], ["_at", tie])
    ends = rows.groupBy(key, "_slice").agg(F.max("_at").alias("_last"))
    over = carried(ends, [key], {"_last": F.max("_last")})
    before = F.coalesce(F.lag("_at").over(order), F.col("_last"))
    begins = F.when(before.isNull() | (F.col("_at") - before > gap), 1).otherwise(0)
    marked = with_carried(rows, over, [key]).withColumn("_begins", begins).drop("_last")
    sums = marked.groupBy(key, "_slice").agg(F.sum("_begins").alias("_sum"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("_here", F.sum("_begins").over(upto))
    numbers = with_carried(counted, carried(sums, [key], {"_sum": F.sum("_sum")}), [key])
    session = F.col("_here") + F.coalesce("_sum", F.lit(0))
    return numbers.select(*df.columns, session.cast("long").alias("session"))


def session_summary(
    df: DataFrame, key: str, time: str, gap: int, tie: str, more: dict[str, Column] | None = None
) -> DataFrame:
    """Per key and session its first and last time, events, and ``more`` aggregates."""
    extra = [value.alias(name) for name, value in (more or {}).items()]
    return with_sessions(df, key, time, gap, tie).groupBy(key, "session").agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"),
        F.count(F.lit(1)).alias("events"), *extra,
    )
