"""Prompt and completion pairs: projections, filters, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import text as T

# Row numbers of a preview that are broadcast at most.
PREVIEW_ROWS = 100_000
ALIASES = {"y_true": "complete", "y_predicted": "y_pred"}


def harmonised(df: DataFrame) -> DataFrame:
    """Result columns under their common names."""
    present = {old: new for old, new in ALIASES.items() if old in df.columns}
    return df.withColumnsRenamed(present)


def prompts_only(df: DataFrame) -> DataFrame:
    return df.select("prompt")


def labelled(df: DataFrame, *keep: str, prompt: Column) -> DataFrame:
    """Pairs of a prompt and the stripped truth."""
    return df.select(*keep, prompt.alias("prompt"), T.strip(F.col("y_true")).alias("complete"))


def both_sides(df: DataFrame) -> DataFrame:
    return df.filter((F.length("prompt") > 0) & (F.length("complete") > 0))


def as_text(df: DataFrame) -> DataFrame:
    """Prompt and completion as text, a missing prompt as the empty string."""
    return df.withColumns(
        {
            "prompt": T.text_or_empty(F.col("prompt")),
            "complete": F.col("complete").cast("string"),
        }
    )


def section(df: DataFrame, task: str) -> DataFrame:
    """The rows of one task, found by the marker in the prompt."""
    return df.filter(T.task_type(F.col("prompt")) == task)


def rows_between(df: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of one position range, ``last`` not included."""
    return df.filter((F.col("row_id") >= first) & (F.col("row_id") < last))


def preview(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each task.

    Their numbers are found on the narrow columns; a few per task, they are then broadcast.
    """
    typed = df.withColumn("task_type", T.task_type(F.col("prompt")))
    order = Window.partitionBy("task_type").orderBy("row_id")
    first = (
        typed.select("task_type", "row_id")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("row_id", "place")
    )
    tasks = len(K.TASK_MARKERS) + 1
    if n * tasks > PREVIEW_ROWS:
        return typed.join(first, "row_id")
    return typed.join(F.broadcast(first), "row_id")


def first_rows(df: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Per task the first row whose prompt holds its marker; a prompt may hold several."""
    held = [
        F.when(F.contains("prompt", F.lit(marker)), F.lit(task))
        for task, marker in (markers or K.TASK_MARKERS).items()
    ]
    return (
        df.select("row_id", F.explode(F.array_compact(F.array(*held))).alias("task"))
        .groupBy("task")
        .agg(F.min("row_id").alias("first_row"))
    )


def longer_than_one(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    return df.filter(F.size(ids) > 1)


def class_examples(df: DataFrame) -> DataFrame:
    return df.filter(F.col("task_type_id") == 1)


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """The task tables under each other, with the task and its place in the order."""
    out = None
    for place, (task, part) in enumerate(parts.items()):
        part = part.withColumns({"task_order": F.lit(place), "task": F.lit(task)})
        out = part if out is None else out.unionByName(part)
    return out
