"""Series without gaps: a row for every step between the first and the last of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfacts.operators.slices import carried, sliced, with_carried, within

# Steps that one row makes at once.
PIECE = 1024


def without_gaps(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, step, observed, last_value, next_value, linear) for every whole step of each key.

    ``df`` has at most one row per key and step, a whole number. ``last_value`` and ``next_value`` are the
    nearest known values at or before and at or behind a step, ``linear`` the value on the line between
    them. Every row makes the steps up to the next row of its key, so the calendar is made where
    the rows are, in slices and in pieces; nothing is joined. Rows without a step are not read.
    """
    columns = df.select(
        F.col(key).alias("_key"), F.col(step).cast("long").alias("_step"), F.col(value).alias("_value")
    ).filter(F.col("_step").isNotNull())
    rows = sliced(columns, ["_key"], ["_step"])
    order = within(["_key"], ["_step"])
    known = F.when(F.col("_value").isNotNull(), F.struct("_step", "_value"))
    first = rows.groupBy("_key", "_slice").agg(
        F.min("_step").alias("_next"), F.min(known).alias("_behind"), F.max(known).alias("_before")
    )
    behind = carried(first, ["_key"], {
        "_next_over": F.min("_next"), "_behind_over": F.last("_behind", ignorenulls=True),
    }, back=True)
    before = carried(first, ["_key"], {"_before_over": F.last("_before", ignorenulls=True)})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    here = rows.withColumns({
        "_next": F.lead("_step").over(order),
        "_last": F.last(known, ignorenulls=True).over(upto),
        "_following": F.first(known, ignorenulls=True).over(later),
    })
    whole = with_carried(with_carried(here, behind, ["_key"]), before, ["_key"]).select(
        "_key", "_step", "_value",
        F.coalesce("_next", "_next_over", F.col("_step") + 1).alias("_end"),
        F.coalesce("_last", "_before_over").alias("_last"),
        F.coalesce("_following", "_behind_over").alias("_following"),
    )
    # A wide gap is made in pieces.
    piece = F.explode(F.sequence(F.col("_step"), F.col("_end") - 1, F.lit(PIECE).cast("long")))
    upper = F.least(F.col("_piece") + PIECE, F.col("_end")) - 1
    made = whole.withColumn("_piece", piece).withColumn(
        "_at", F.explode(F.sequence(F.col("_piece"), upper))
    )
    own = F.col("_at") == F.col("_step")
    next_value = F.when(own & F.col("_value").isNotNull(), F.col("_last")).otherwise(F.col("_following"))
    last, after = F.col("_last"), F.col("_next_known")
    rise, gone = after["_value"] - last["_value"], F.col("_at") - last["_step"]
    linear = F.when(
        after["_step"] > last["_step"],
        last["_value"] + rise * gone / (after["_step"] - last["_step"]),
    ).when(after["_step"] == last["_step"], last["_value"] + F.lit(0.0))
    return made.withColumn("_next_known", next_value).select(
        F.col("_key").alias(key), F.col("_at").alias(step), own.alias("observed"),
        last["_value"].alias("last_value"), after["_value"].alias("next_value"), linear.alias("linear"),
    )
