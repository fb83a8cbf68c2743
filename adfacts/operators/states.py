"""Reports over a growing folder of results, from partial aggregates that are stored per file.

A state has, per file, how often each value of each measure occurs: labels of both sides with hits, tasks
with right answers, parts of salaries with hits, and seconds. All of these add up, so a file's state is
written once, replaced or deleted without reading any other file, and a report is the sum of the
states: macro metrics from the sums of labels, exact quartiles from the sums of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.functions.answers import PARTS
from adfacts.operators.evaluate import _part_hit, _with_parts, marked
from adfacts.operators.grouping import running_totals, spread_join

SCHEMA = "model string, measure string, value string, n bigint, hits bigint, predicted bigint"


def state_of(results: DataFrame) -> DataFrame:
    """The state of one file's results (model, prompt, complete, y_pred, inference_time)."""
    rows = _with_parts(marked(results), strict=False)
    one, none = F.lit(1), F.lit(0)
    hit = F.col("val").cast("int")

    def part(measure: str, value: Column, n: Column, hits: Column, predicted: Column = none) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"), value.cast("string").alias("value"), n.alias("n"),
            F.coalesce(hits, none).alias("hits"), predicted.alias("predicted"),
        )

    salary = F.col("task_type") == "Salary"
    parts = [
        part("label", F.col("complete"), one, hit),
        part("label", F.col("y_pred"), none, none, one),
        part("task", F.col("task_type"), one, hit),
        *[F.when(salary, part("part", F.lit(p), one, _part_hit(p))) for p in PARTS],
    ]
    if "inference_time" in results.columns:
        parts.append(F.when(F.col("inference_time").isNotNull(), part("seconds", F.col("inference_time"), one, none)))
    return (
        rows.select("model", F.inline(F.array_compact(F.array(*parts))))
        .groupBy("model", "measure", "value")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "hits", "predicted")])
    )


class States:
    """The states of all files of a folder, a sub-folder each, so that one is replaced at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, file: str, results: DataFrame) -> None:
        """Add the state of a file, or replace it."""
        path = f"{self.folder}/state-{self._name(file)}"
        state_of(results).write.mode("overwrite").parquet(path)

    def delete(self, file: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-{self._name(file)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path) or not files.listStatus(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/state-*")

    @staticmethod
    def _name(file: str) -> str:
        """A file's name as a folder's, its bytes in hexadecimal."""
        return file.encode().hex()


def report_of(states: DataFrame) -> DataFrame:
    """The report of ``evaluate.report`` from states, with quartiles of the seconds."""
    sums = states.groupBy("model", "measure", "value").agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "predicted")]
    )
    measure, value = F.col("measure"), F.col("value")
    n, hits, predicted = F.col("n"), F.col("hits"), F.col("predicted")
    task, label, part = (measure == m for m in ("task", "label", "part"))
    aggs = [
        F.sum(F.when(task, n)).alias("rows"),
        (F.sum(F.when(task, hits)) / F.sum(F.when(task, n))).alias("accuracy"),
    ]
    for name in ("Salary", "Seniority", "Work Arrangement"):
        column = name.lower().replace(" ", "_")
        of = task & (value == name)
        aggs += [
            F.coalesce(F.sum(F.when(of, c)), F.lit(0)).alias(f"{column}_{kind}")
            for c, kind in ((hits, "correct"), (n, "total"))
        ]
    aggs += [
        (F.sum(F.when(part & (value == p), hits)) / F.sum(F.when(part & (value == p), n))).alias(f"{p}_accuracy")
        for p in PARTS
    ]
    known = label & value.isNotNull()
    recall = F.when(n > 0, hits / n).otherwise(F.lit(0.0))
    aggs += [
        F.avg(F.when(known, recall)).alias("macro_recall"),
        F.avg(F.when(known, 2 * hits / (n + predicted))).alias("macro_f1"),
    ]
    mean = sum((F.col(f"{p}_accuracy") for p in PARTS), F.lit(0.0)) / len(PARTS)
    return sums.groupBy("model").agg(*aggs).withColumn("mean_accuracy", mean)


def quartiles_of(states: DataFrame) -> DataFrame:
    """Per model the exact quartiles of the seconds (linear), from how often each value occurs."""
    seconds = F.col("value").cast("double")
    counted = (
        states.filter(F.col("measure") == "seconds")
        .groupBy("model", seconds.alias("v")).agg(F.sum("n").alias("_n"))
    )
    ranked = running_totals(counted, ["model"], [F.col("v")], {"_before": F.col("_n")})
    totals = counted.groupBy("model").agg(F.sum("_n").alias("count"))
    placed = spread_join(ranked, totals, ["model"], ["v"])
    before = F.coalesce("_before", F.lit(0))
    picks = []
    for q in (25, 50, 75):
        at = (F.col("count") - 1) * (q / 100)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (before <= place) & (place < before + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("v"))).alias(f"_{side}{q}"))
    found = placed.groupBy("model").agg(F.max("count").alias("count"), *picks)

    def quartile(q: int) -> Column:
        at = (F.col("count") - 1) * (q / 100)
        low, high = F.col(f"_low{q}"), F.col(f"_high{q}")
        return (low + (high - low) * (at - F.floor(at))).alias(f"p{q}")

    return found.select("model", "count", *[quartile(q) for q in (25, 50, 75)])
