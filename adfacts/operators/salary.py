"""The rules over a whole table of ads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.functions import rules as R
from adfacts.functions.text import lowered


def salary_facts(ads: DataFrame) -> DataFrame:
    """All salary columns of each ad, down to ``y_pred``; one projection chain, no shuffle."""
    nation = F.col("nation_short_desc")
    ends = [F.col(c) for c in ("min1", "max1", "min2", "max2")]
    return (
        ads.withColumn("_one", R.compensation(F.col("job_ad_details"), nation))
        .withColumns(
            {
                "_ad": lowered(F.col("job_ad_details")),
                "_pay": lowered(F.col("salary_additional_text")),
            }
        )
        .withColumn("_two", R.salary_range(F.col("_pay")))
        .withColumns(
            {
                "min1": F.col("_one.min1"),
                "max1": F.col("_one.max1"),
                "min2": F.col("_two.min2"),
                "max2": F.col("_two.max2"),
                "freq1": R.pay_frequency(F.col("_ad")),
                "freq2": R.pay_frequency(F.col("_pay")),
            }
        )
        .withColumn("frequency", R.resolve_frequency(nation, *ends, F.col("freq1"), F.col("freq2")))
        .withColumn("_range", R.resolve_range(nation, *ends))
        .withColumn(
            "y_pred",
            R.format_salary(
                F.col("_range.min"), F.col("_range.max"), F.col("_range.currency"),
                F.col("frequency"),
            ),
        )
        .withColumns({"currency": F.col("_range.currency")})
        .drop("_one", "_ad", "_pay", "_two", "_range")
    )
