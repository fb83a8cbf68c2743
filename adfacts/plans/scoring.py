"""Queries over batch scoring, latency and candidate filters."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.operators import scoring as S
from adfacts.plans.registry import register
from adfacts.session import pinned


def _count_words():
    """Stand-in for a model: says how many words the prompt has."""
    return lambda prompts: [f"{len(p.split(' '))} words" for p in prompts]


@register(
    "bs1_score", "pairs",
    "SELECT pair_id, cast(len(string_split(prompt, ' ')) AS VARCHAR) || ' words' AS y_pred FROM pairs",
)
def bs1(pairs: DataFrame) -> DataFrame:
    return S.score(pairs.select("pair_id", "prompt"), _count_words).select("pair_id", "y_pred")


def _slow_batches():
    """Stand-in that answers with the batch's own name, its size and the seconds it took."""

    def answer(prompts: list[str]) -> list[str]:
        started = time.perf_counter()
        time.sleep(0.0005)
        name = uuid.uuid4().hex
        return [f"{name} {len(prompts)} {time.perf_counter() - started}"] * len(prompts)

    return answer


@register("bs2_row_time", "pairs", "SELECT pair_id, true AS timed FROM pairs")
def bs2(pairs: DataFrame) -> DataFrame:
    """Rows of a batch have one time; together no less than the model took, nor much more."""
    scored = pinned(S.score(pairs.select("pair_id", "prompt"), _slow_batches))
    spent = F.col("inference_time")
    batch = F.split("y_pred", " ")
    per_batch = scored.groupBy("y_pred").agg(
        F.count_distinct(spent).alias("times"), F.count(spent).alias("rows"), F.sum(spent).alias("total"),
    )
    timed = (
        (F.col("times") == 1)
        & (F.col("rows") == batch[1].cast("int"))
        & (F.col("total") >= batch[2].cast("double") - 1e-9)
        & (F.col("total") <= batch[2].cast("double") + 1)
    )
    return scored.join(per_batch, "y_pred").select("pair_id", timed.alias("timed"))


def _moody_caller():
    def call(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ConnectionError("no answer")
        return f" {len(prompt)} "

    return call


@register(
    "bs3_retries", "pairs",
    """SELECT pair_id, CASE WHEN length(prompt) % 5 = 0 THEN 'API_ERROR' ELSE cast(length(prompt) AS VARCHAR) END AS y_pred,
  length(prompt) % 5 = 0 AS no_time FROM pairs""",
)
def bs3(pairs: DataFrame) -> DataFrame:
    called = S.score_calls(pairs.select("pair_id", "prompt"), _moody_caller, delay=0.0)
    return called.select("pair_id", "y_pred", (F.col("inference_time") == 0.0).alias("no_time"))


@register(
    "bs3_sentinel_rate", "pairs",
    """SELECT CASE WHEN pair_id % 200 < 100 THEN 'model_a' ELSE 'model_b' END AS model, count(*) AS calls,
  count(*) FILTER (length(prompt) % 5 = 0) AS failed,
  round(avg((length(prompt) % 5 = 0)::INTEGER), 6) AS failed_share FROM pairs GROUP BY 1""",
)
def bs3_rate(pairs: DataFrame) -> DataFrame:
    model = F.when(F.col("pair_id") % 200 < 100, "model_a").otherwise("model_b")
    asked = pairs.select("prompt", model.alias("model"))
    rate = S.sentinel_rate(S.score_calls(asked, _moody_caller, delay=0.0), "model")
    return rate.withColumn("failed_share", F.round("failed_share", 6))


_QUARTILES = ", ".join(
    f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (25, 50, 75)
)


_SUMMARY = f"""count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, {_QUARTILES}, max(value) AS max, round(sum(value), 6) AS total FROM events"""


def _summary(events: DataFrame, *keys: str) -> DataFrame:
    rounded = ("mean", "std", "p25", "p50", "p75", "total")
    summary = S.latency_summary(events, "value", keys)
    return summary.withColumns({c: F.round(c, 6) for c in rounded})


@register("bs4_latency_summary", "events", f"SELECT {_SUMMARY}")
def bs4(events: DataFrame) -> DataFrame:
    return _summary(events)


@register("bs4_latency_by_kind", "events", f"SELECT event_type, {_SUMMARY} GROUP BY 1")
def bs4_by_kind(events: DataFrame) -> DataFrame:
    return _summary(events, "event_type")


BANNED = [3, 14, 15]
SHARES = f"""s AS (SELECT label, vec_id, score / 0.8 AS s FROM candidates WHERE vec_id NOT IN (3, 14, 15)),
t AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM s),
probs AS (SELECT label, vec_id, e / sum(e) OVER (PARTITION BY label) AS prob FROM t)"""
TOP = f"""{SHARES}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prob DESC, vec_id) AS place FROM probs),
top AS (SELECT label, vec_id, prob / sum(prob) OVER (PARTITION BY label) AS prob FROM placed WHERE place <= 50)"""


def _nucleus(source: str) -> str:
    return f"""before AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY label ORDER BY prob DESC, vec_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {source}),
kept AS (SELECT label, vec_id, prob / sum(prob) OVER (PARTITION BY label) AS prob FROM before WHERE round(b, 9) <= 0.9)"""


def _softmax(candidates: DataFrame) -> DataFrame:
    return S.softmax(candidates, "label", "vec_id", "score", banned=BANNED)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("label", "vec_id", F.round("prob", 9).alias("prob"))


@register("sc1_softmax", "candidates", f"WITH {SHARES} SELECT label, vec_id, round(prob, 9) AS prob FROM probs")
def sc1(candidates: DataFrame) -> DataFrame:
    return _shown(_softmax(candidates))


@register("sc2_top_k", "candidates", f"WITH {TOP} SELECT label, vec_id, round(prob, 9) AS prob FROM top")
def sc2(candidates: DataFrame) -> DataFrame:
    return _shown(S.top_k(_softmax(candidates), "label", "vec_id"))


@register(
    "sc3_nucleus", "candidates",
    f"WITH {SHARES}, {_nucleus('probs')} SELECT label, vec_id, round(prob, 9) AS prob FROM kept",
)
def sc3(candidates: DataFrame) -> DataFrame:
    return _shown(S.nucleus(_softmax(candidates), "label", "vec_id"))


@register(
    "sc3_top_k_nucleus", "candidates",
    f"WITH {TOP}, {_nucleus('top')} SELECT label, vec_id, round(prob, 9) AS prob FROM kept",
)
def sc3_top(candidates: DataFrame) -> DataFrame:
    best = S.top_k(_softmax(candidates), "label", "vec_id").drop("place")
    return _shown(S.nucleus(best, "label", "vec_id"))
