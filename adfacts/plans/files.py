"""Queries that write derived tables to files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.operators import pairs as P
from adfacts.operators.salary import salary_facts
from adfacts.plans.evaluating import REPORT_SQL, rounded_report
from adfacts.plans.registry import register
from adfacts.plans.rules import FACTS
from adfacts.session import new_folder
from adfacts.sources import tables as S


@register(
    "io1_read_ads_csv", "ads",
    "SELECT job_title, job_ad_details, nation_short_desc, salary_additional_text, y_true FROM ads",
)
def io1(ads: DataFrame) -> DataFrame:
    # As in real files: other columns as well, in another order.
    path = new_folder(ads.sparkSession, "ads-csv")
    S.write_csv(ads, path, "ad_id", *reversed(S.SALARY_ADS.names), "job_summary")
    return S.read_csv(ads.sparkSession, path, S.SALARY_ADS)


@register("io2_read_records", "pairs", "SELECT prompt, complete FROM pairs")
def io2(pairs: DataFrame) -> DataFrame:
    path = new_folder(pairs.sparkSession, "records-json")
    S.write_records(pairs.select("prompt", "complete"), path)
    return S.read_records(pairs.sparkSession, path, S.PAIRS)


@register("io3_write_rule_results", "ads", f"WITH {FACTS} SELECT y_true, y_pred FROM facts", heavy=True)
def io3(ads: DataFrame) -> DataFrame:
    path = new_folder(ads.sparkSession, "rule-results-csv")
    S.write_csv(salary_facts(ads), path, *S.RULE_RESULTS.names)
    return S.read_csv(ads.sparkSession, path, S.RULE_RESULTS)


@register("io4_write_records_ascii", "pairs", "SELECT prompt, complete FROM pairs")
def io4(pairs: DataFrame) -> DataFrame:
    path = new_folder(pairs.sparkSession, "records-ascii")
    S.write_records(pairs.select("prompt", "complete"), path, ascii_only=True)
    return S.read_records(pairs.sparkSession, path, S.PAIRS)


@register("io5_report_per_file", "predictions", REPORT_SQL)
def io5(predictions: DataFrame) -> DataFrame:
    folder = new_folder(predictions.sparkSession, "results")
    columns = [
        ("model_a", {}),
        ("model_b", {"complete": "y_true", "y_pred": "y_predicted"}),
    ]
    for model, renamed in columns:
        rows = predictions.filter(F.col("model") == model).drop("model")
        S.write_records(rows.withColumnsRenamed(renamed), f"{folder}/{model}.json")
    return rounded_report(S.read_results(predictions.sparkSession, folder))


@register("io6_harmonised", "predictions", "SELECT row_id, complete, y_pred FROM predictions")
def io6(predictions: DataFrame) -> DataFrame:
    old = predictions.select(
        "row_id", F.col("complete").alias("y_true"), F.col("y_pred").alias("y_predicted")
    )
    return P.harmonised(old)


@register("io7_prompts_only", "corpus", "SELECT prompt FROM corpus")
def io7(corpus: DataFrame) -> DataFrame:
    return P.prompts_only(corpus)
