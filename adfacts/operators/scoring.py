"""Asking a model the caller brings, its latency, and filtering scored candidates.

What goes to Python workers here are functions inside of functions, which are shipped whole, so
that the package need not be installed there. A caller's own function may use what workers have.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.operators.grouping import group_join, running_totals, spread_join
from adfacts.session import pinned

Answerer = Callable[[list[str]], list[str]]


def score(
    df: DataFrame,
    make_answerer: Callable[[], Answerer],
    prompt: str = "prompt",
    batch_size: int = K.BATCH_SIZE,
    null_on_error: bool = False,
) -> DataFrame:
    """Add ``y_pred`` and ``inference_time`` (seconds of the batch per row).

    ``make_answerer`` runs once per task and may load a model. It has to return an answer per
    prompt. ``null_on_error`` gives a batch whose call raised null answers instead of ending
    the job.
    """

    def asked(answer: Answerer, batch: list[str]) -> list[str | None]:
        try:
            found = answer(batch)
        except Exception:
            if null_on_error:
                return [None] * len(batch)
            raise
        if len(found) != len(batch):
            raise ValueError(f"{len(found)} answers to {len(batch)} prompts")
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_answerer()
        for frame in frames:
            prompts = frame[prompt].tolist()
            answers: list[str | None] = []
            seconds: list[float] = []
            for at in range(0, len(prompts), batch_size):
                batch = prompts[at : at + batch_size]
                started = time.perf_counter()
                answers += asked(answer, batch)
                seconds += [(time.perf_counter() - started) / len(batch)] * len(batch)
            yield frame.assign(y_pred=answers, inference_time=seconds)

    return df.mapInPandas(run, _answered(df))


def score_calls(
    df: DataFrame,
    make_caller: Callable[[], Callable[[str], str]],
    prompt: str = "prompt",
    tries: int = K.CALL_TRIES,
    delay: float = 2.0,
    sentinel: str = "API_ERROR",
) -> DataFrame:
    """As ``score`` for a remote call per prompt: tried a few times, then the sentinel."""

    def called(call: Callable[[str], str], text: str) -> tuple[str, float]:
        for _ in range(tries):
            started = time.perf_counter()
            try:
                return call(text).strip(), time.perf_counter() - started
            except Exception:
                time.sleep(delay)
        return sentinel, 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_caller()
        for frame in frames:
            results = [called(call, p) for p in frame[prompt]]
            yield frame.assign(
                y_pred=[a for a, _ in results], inference_time=[s for _, s in results]
            )

    return df.mapInPandas(run, _answered(df))


def _answered(df: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, "y_pred string", "inference_time double"])


def sentinel_rate(df: DataFrame, key: str, sentinel: str = "API_ERROR") -> DataFrame:
    failed = F.when(F.col("y_pred") == sentinel, 1).otherwise(0)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(failed).alias("failed"),
        F.avg(failed).alias("failed_share"),
    )


def latency_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles (linear) and total per group.

    The quartiles are exact: equal values are counted first, then ranked across the table.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    v = F.col(value)
    base = known.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(v).alias("total"),
    )
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, keys, [v], {"_before": F.col("_n")})
    if keys:
        placed = spread_join(ranked, base.select(*keys, "count"), keys, [value])
    else:
        placed = ranked.withColumn("count", base.select("count").scalar())
    before = F.coalesce("_before", F.lit(0))
    picks = []
    for q in (25, 50, 75):
        at = (F.col("count") - 1) * (q / 100)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (before <= place) & (place < before + F.col("_n"))
            picks.append(F.max(F.when(here, v)).alias(f"_{side}{q}"))
    ends = placed.groupBy(*keys).agg(*picks)

    def quartile(q: int) -> Column:
        at = (F.col("count") - 1) * (q / 100)
        low, high = F.col(f"_low{q}"), F.col(f"_high{q}")
        return (low + (high - low) * (at - F.floor(at))).alias(f"p{q}")

    # Both hold one row per group; under each other they need no join, and a group may be null.
    both = base.unionByName(ends, allowMissingColumns=True)
    known_values = [F.max(c).alias(c) for c in both.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(*known_values)
        .select(
            *keys, "count", "mean", "std", "min", *[quartile(q) for q in (25, 50, 75)],
            "max", "total",
        )
    )


def softmax(
    df: DataFrame, group: str, item: str, score_col: str,
    banned: list | None = None, temperature: float = 0.8,
) -> DataFrame:
    """Candidates without the banned items, with their share ``prob`` in the group."""
    kept = df.filter(~F.col(item).isin(banned)) if banned else df
    kept = kept.withColumn("_s", F.col(score_col).cast("double") / temperature)
    # Sums per unit of the score, each from its own floor, and then per group from the top one:
    # one pass gives both what to raise from and the total.
    unit = F.floor("_s")
    units = kept.groupBy(group, unit.alias("_unit")).agg(F.sum(F.exp(F.col("_s") - unit)).alias("_e"))
    top = F.max("_unit").over(Window.partitionBy(group))
    totals = (
        units.withColumn("_top", top)
        .groupBy(group, "_top")
        .agg(F.sum(F.col("_e") * F.exp(F.col("_unit") - F.col("_top"))).alias("_total"))
    )
    return (
        group_join(kept, totals, [group])
        .withColumn("prob", F.exp(F.col("_s") - F.col("_top")) / F.col("_total"))
        .drop("_s", "_top", "_total")
    )


def top_k(df: DataFrame, group: str, item: str, k: int = 50) -> DataFrame:
    """The ``k`` best of each group, renormalised; ties by item."""
    of_group = Window.partitionBy(group)
    best = of_group.orderBy(F.col("prob").desc(), F.col(item))
    return (
        df.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .withColumn("prob", F.col("prob") / F.sum("prob").over(of_group))
    )


def nucleus(df: DataFrame, group: str, item: str, p: float = 0.9) -> DataFrame:
    """The best of each group until their share first exceeds ``p``, renormalised."""
    order = [F.col("prob").desc(), F.col(item)]
    summed = running_totals(df, [group], order, {"_before": F.col("prob")})
    kept = pinned(summed.filter(F.round(F.coalesce("_before", F.lit(0.0)), 9) <= p).drop("_before"))
    total = kept.groupBy(group).agg(F.sum("prob").alias("_total"))
    return (
        group_join(kept, total, [group])
        .withColumn("prob", F.col("prob") / F.col("_total"))
        .drop("_total")
    )
