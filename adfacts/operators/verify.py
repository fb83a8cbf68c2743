"""Choosing among the attempts at one prompt, and making them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import answers as A
from adfacts.functions.text import task_type
from adfacts.operators.scoring import Answerer, score
from adfacts.session import new_folder


def checked(attempts: DataFrame, mode: str = "direct", onsite_label: str = "OnSite") -> DataFrame:
    """Attempts with the cleaned answer and whether it may be accepted.

    A null ``raw`` is an attempt that raised; it is never valid.
    """
    valid = A.valid_answer(F.col("cleaned"), F.col("task_type"), onsite_label)
    return attempts.withColumn(
        "cleaned", A.clean_answer(F.col("raw"), F.col("task_type"), mode)
    ).withColumn("valid", F.col("raw").isNotNull() & valid)


def first_valid(checked_attempts: DataFrame, max_tries: int = K.MAX_TRIES) -> DataFrame:
    """Per prompt the first valid answer, else the unchecked last one, and the failures before it."""
    attempt = F.col("attempt")
    early = attempt <= max_tries
    accepted = F.when(F.col("valid") & early, attempt)
    last = F.when(attempt == max_tries + 1, attempt)
    failed = F.when(~F.col("valid") & early, attempt)
    return (
        checked_attempts.groupBy("prompt_id")
        .agg(
            F.min(accepted).alias("accepted_attempt"),
            F.min_by("cleaned", accepted).alias("_accepted"),
            F.min_by("cleaned", last).alias("_last"),
            F.collect_set(failed).alias("_failed"),
        )
        .select(
            "prompt_id",
            F.coalesce("_accepted", "_last").alias("answer"),
            F.col("accepted_attempt").isNotNull().alias("accepted"),
            F.size(
                F.filter(
                    "_failed",
                    lambda a: a < F.coalesce("accepted_attempt", F.lit(max_tries + 1)),
                )
            ).alias("re_attempts"),
        )
    )


def total_re_attempts(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.sum("re_attempts").alias("re_attempts"))


def attempt_until_valid(
    prompts: DataFrame,
    answerer_for: Callable[[int], Callable[[], Answerer]],
    max_tries: int = K.MAX_TRIES,
    mode: str = "direct",
    folder: str | None = None,
) -> DataFrame:
    """Ask in rounds, each round only the prompts the last one left without a valid answer.

    An attempt whose call raised counts as failed. Every round is written before the next one reads it: a model may answer differently
    when a lost task is run again. Returns all attempts, checked.
    """
    spark = prompts.sparkSession
    folder = folder or new_folder(spark, "attempts")
    pending = prompts.withColumn("task_type", task_type(F.col("prompt"), "default"))
    rounds = []
    for attempt in range(1, max_tries + 2):
        asked = score(pending, answerer_for(attempt), null_on_error=True)
        asked = asked.withColumnRenamed("y_pred", "raw")
        path = f"{folder}/round-{attempt}"
        checked(asked.withColumn("attempt", F.lit(attempt)), mode).write.parquet(path)
        done = spark.read.parquet(path)
        rounds.append(done)
        pending = done.filter(~F.col("valid")).select(*pending.columns)
        if pending.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        out = out.unionByName(later)
    return out
