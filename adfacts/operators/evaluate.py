"""How good the answers are: per task, over all labels, and per part of a salary.

``keys`` are extra grouping columns, such as the model; none gives one report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfacts.functions import answers as A
from adfacts.functions.answers import PARTS
from adfacts.functions.text import task_type


def marked(df: DataFrame) -> DataFrame:
    """Results with the task and whether the answer is the truth."""
    return df.withColumns(
        {
            "task_type": task_type(F.col("prompt")),
            "val": A.same(F.col("complete"), F.col("y_pred")),
        }
    )


def task_scores(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Correct, total and percent per task; rows without a task are left out."""
    return (
        marked(results)
        .filter(F.col("task_type") != "Unknown")
        .groupBy(*keys, "task_type")
        .agg(F.count_if("val").alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("percent", F.col("correct") / F.col("total") * 100)
    )


def accuracy(
    results: DataFrame, keys: Sequence[str] = (), truth: str = "complete", pred: str = "y_pred"
) -> DataFrame:
    right = A.same(F.col(truth), F.col(pred)).cast("int")
    return results.groupBy(*keys).agg(F.avg(right).alias("accuracy"))


def label_scores(
    results: DataFrame, keys: Sequence[str] = (), truth: str = "complete", pred: str = "y_pred"
) -> DataFrame:
    """Per label its rows, how often it was answered and how often rightly.

    Both sides of a row are counted in one pass, so the union of the labels needs no join.
    """
    t, p = F.col(truth), F.col(pred)
    one, none = F.lit(1), F.lit(0)
    hit = A.same(t, p).cast("int")
    sides = F.array(
        F.struct(t.alias("label"), one.alias("s"), none.alias("p"), hit.alias("h")),
        F.struct(p.alias("label"), none.alias("s"), one.alias("p"), none.alias("h")),
    )
    return (
        results.select(*keys, F.inline(sides))
        .filter(F.col("label").isNotNull())
        .groupBy(*keys, "label")
        .agg(
            F.sum("s").alias("support"),
            F.sum("p").alias("predicted"),
            F.sum("h").alias("hits"),
        )
    )


def macro_scores(
    results: DataFrame, keys: Sequence[str] = (), truth: str = "complete", pred: str = "y_pred"
) -> DataFrame:
    """Recall and F1 averaged over all labels of truths and answers, 0 where undefined."""
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    recall = F.when(support > 0, hits / support).otherwise(F.lit(0.0))
    f1 = 2 * hits / (support + predicted)
    return (
        label_scores(results, keys, truth, pred)
        .groupBy(*keys)
        .agg(F.avg(recall).alias("macro_recall"), F.avg(f1).alias("macro_f1"))
    )


def _with_parts(df: DataFrame, strict: bool) -> DataFrame:
    if strict:
        predicted, true = (A.strict_salary_parts(F.col(c)) for c in ("y_pred", "complete"))
    else:
        predicted = A.salary_parts(A.reported_salary(F.col("y_pred")))
        true = A.salary_parts(F.col("complete"))
    return df.withColumns({"_predicted": predicted, "_true": true})


def _part_hit(part: str) -> Column:
    return A.same(F.col(f"_predicted.{part}"), F.col(f"_true.{part}")).cast("int")


def salary_part_scores(
    results: DataFrame, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Share of salary rows with the right minimum, maximum, currency, frequency; their mean.

    ``strict`` splits the raw answer instead of finding a salary in it.
    """
    shares = [F.avg(_part_hit(part)).alias(f"{part}_accuracy") for part in PARTS]
    mean = sum((F.col(f"{part}_accuracy") for part in PARTS), F.lit(0.0)) / len(PARTS)
    salaries = results.filter(task_type(F.col("prompt")) == "Salary")
    return (
        _with_parts(salaries, strict)
        .groupBy(*keys)
        .agg(*shares)
        .withColumn("mean_accuracy", mean)
    )


def report(results: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """All of the above in one row per model: two passes over the results.

    A null model is a model; one without any label has null recall and F1. Without keys, one
    row for all results.
    """
    rows = _with_parts(marked(results), strict=False)
    task, val = F.col("task_type"), F.col("val")
    aggs = [F.count(F.lit(1)).alias("rows"), F.avg(val.cast("int")).alias("accuracy")]
    for name in ("Salary", "Seniority", "Work Arrangement"):
        column = name.lower().replace(" ", "_")
        aggs += [
            F.count_if((task == name) & val).alias(f"{column}_correct"),
            F.count_if(task == name).alias(f"{column}_total"),
        ]
    aggs += [
        F.avg(F.when(task == "Salary", _part_hit(part))).alias(f"{part}_accuracy")
        for part in PARTS
    ]
    mean = sum((F.col(f"{part}_accuracy") for part in PARTS), F.lit(0.0)) / len(PARTS)
    counted = rows.groupBy(*keys).agg(*aggs).withColumn("mean_accuracy", mean)
    # Both hold one row per group; under each other they need no join, and a group may be null.
    both = counted.unionByName(macro_scores(results, keys), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def grouped_scores(results: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows, accuracy, macro recall and F1 for several groupings by one pass over the results.

    ``sets`` are lists of columns out of ``model`` and ``task_type``; a column that a set lacks is null
    and ``level`` names the set's columns, joined by commas. Averages over labels do not add up over
    groups, so the counts of every label are kept for each set, and averaged then.
    """
    t, p = F.col("complete"), F.col("y_pred")
    one, none = F.lit(1), F.lit(0)
    sides = F.array(
        F.struct(t.alias("label"), one.alias("s"), none.alias("p"), F.coalesce(F.col("val").cast("int"), none).alias("h")),
        F.struct(p.alias("label"), none.alias("s"), one.alias("p"), none.alias("h")),
    )

    def member(columns: Sequence[str]) -> Column:
        return F.struct(
            F.lit(",".join(columns)).alias("level"),
            *[(F.col(f"_{c}") if c in columns else F.lit(None).cast("string")).alias(c) for c in ("model", "task_type")],
        )

    rows = marked(results).withColumnsRenamed({"model": "_model", "task_type": "_task_type"})
    counted = (
        rows.select("_model", "_task_type", F.inline(sides))
        # Counted once for the finest set before it is copied for the others.
        .groupBy("_model", "_task_type", "label").agg(*[F.sum(c).alias(c) for c in "sph"])
        .select(F.inline(F.array(*[member(columns) for columns in sets])), "label", "s", "p", "h")
        .groupBy("level", "model", "task_type", "label").agg(*[F.sum(c).alias(c) for c in "sph"])
    )
    known, s, hits = F.col("label").isNotNull(), F.col("s"), F.col("h")
    recall = F.when(s > 0, hits / s).otherwise(F.lit(0.0))
    return counted.groupBy("level", "model", "task_type").agg(
        F.sum(s).alias("rows"), (F.sum(hits) / F.sum(s)).alias("accuracy"),
        F.avg(F.when(known, recall)).alias("macro_recall"),
        F.avg(F.when(known, 2 * hits / (s + F.col("p")))).alias("macro_f1"),
    )
