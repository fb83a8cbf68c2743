"""Queries over the pay and arrangement rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import rules as R
from adfacts.functions.text import lowered, strip
from adfacts.operators import evaluate as E
from adfacts.operators.salary import salary_facts
from adfacts.plans import checksql as C
from adfacts.plans.registry import register


def _after(heading: str) -> str:
    pattern = rf"(?s)>\s*{heading}\s*<.*?<p(?:\s[^>]*)?>(.*?)</p>"
    return f"regexp_extract(job_ad_details, {C.quoted(pattern)}, 1)"


def _numbers(x: str) -> str:
    return rf"""list_transform(regexp_extract_all({x}, '\d[\d,]*'), lambda n: replace(n, ',', '')::BIGINT)"""


COMPENSATION = f"""texts AS (SELECT *, {C.strip(_after("Compensation"))} AS t1,
    {_after("Compensation Range")} AS t2 FROM ads),
numbers AS (SELECT *, {_numbers("t1")} AS single, list_sort({_numbers("t2")}) AS band FROM texts),
one AS (SELECT *,
    CASE WHEN nation_short_desc = 'PH' AND len(single) > 0 THEN single[1]
      WHEN len(band) > 0 THEN band[1]
      WHEN nation_short_desc <> 'PH' AND regexp_matches(t1, '^[0-9]+$') THEN t1::BIGINT END AS min1,
    CASE WHEN nation_short_desc = 'PH' AND len(single) > 0 THEN single[1]
      WHEN len(band) > 1 THEN band[2] WHEN len(band) = 1 THEN band[1]
      WHEN nation_short_desc <> 'PH' AND regexp_matches(t1, '^[0-9]+$') THEN t1::BIGINT END AS max1
  FROM numbers)"""

PAY = f"""pay AS (SELECT *, lower(coalesce(salary_additional_text, '')) AS low_pay,
    lower(job_ad_details) AS low_ad FROM one),
amounts AS (SELECT *, list_filter(list_transform(list_filter(
      regexp_extract_all(low_pay, '\\$?(\\d{{1,7}}(?:,\\d{{3}})*(?:\\.\\d+)?%?)', 1),
      lambda n: NOT ends_with(n, '%')),
    lambda n: round_even(replace(n, ',', '')::DOUBLE, 0)::BIGINT), lambda n: n >= 10) AS kept FROM pay),
two AS (SELECT *, list_min(kept) AS min2, list_max(kept) AS max2,
    {C.frequency("low_ad")} AS freq1, {C.frequency("low_pay")} AS freq2 FROM amounts)"""

RESOLVED = f"""three AS (SELECT *,
    (min2 IS NOT NULL AND max2 IS NOT NULL) AS has2, (min1 IS NOT NULL AND max1 IS NOT NULL) AS has1 FROM two),
four AS (SELECT *,
    CASE WHEN nation_short_desc = 'AUS' THEN
        CASE WHEN (has1 OR has2) AND freq2 IS NULL THEN coalesce(freq1, 'ANNUAL') ELSE 'ANNUAL' END
      WHEN nation_short_desc = 'ID' THEN 'MONTHLY'
      WHEN nation_short_desc IN ('MY', 'NZ', 'PH') AND (min1 IS NOT NULL OR min2 IS NOT NULL)
        AND freq2 IS NULL THEN 'MONTHLY'
      ELSE coalesce(freq2, freq1) END AS frequency,
    CASE WHEN has2 THEN min2 WHEN has1 THEN min1 ELSE 0 END AS min3,
    CASE WHEN has2 THEN max2 WHEN has1 THEN max1 ELSE 0 END AS max3,
    CASE WHEN has1 OR has2 THEN CASE nation_short_desc {" ".join(
        f"WHEN {C.quoted(n)} THEN {C.quoted(c)}" for n, c in K.NATION_CURRENCY.items()
    )} ELSE 'None' END ELSE 'None' END AS currency FROM three),
facts AS (SELECT *, CASE WHEN min3 <> 0 AND max3 <> 0
    THEN concat(min3, '-', max3, '-', currency, '-', coalesce(frequency, 'None'))
    ELSE '0-0-None-None' END AS y_pred FROM four)"""

FACTS = f"{COMPENSATION}, {PAY}, {RESOLVED}"


@register("rx1_compensation", "ads", f"WITH {COMPENSATION} SELECT ad_id, min1, max1 FROM one", heavy=True)
def rx1(ads: DataFrame) -> DataFrame:
    ends = R.compensation(F.col("job_ad_details"), F.col("nation_short_desc"))
    return ads.select("ad_id", ends.alias("e")).select("ad_id", "e.*")


@register(
    "rx2_pay_frequency", "ads",
    f"""SELECT ad_id, {C.frequency("lower(job_ad_details)")} AS freq1,
  {C.frequency("lower(coalesce(salary_additional_text, ''))")} AS freq2 FROM ads""",
    heavy=True,
)
def rx2(ads: DataFrame) -> DataFrame:
    return ads.select(
        "ad_id",
        R.pay_frequency(lowered(F.col("job_ad_details"))).alias("freq1"),
        R.pay_frequency(lowered(F.col("salary_additional_text"))).alias("freq2"),
    )


@register("rx3_salary_range", "ads", f"WITH {COMPENSATION}, {PAY} SELECT ad_id, min2, max2 FROM two", heavy=True)
def rx3(ads: DataFrame) -> DataFrame:
    ends = R.salary_range(lowered(F.col("salary_additional_text")))
    return ads.select("ad_id", ends.alias("e")).select("ad_id", "e.*")


@register("rx4_resolve_frequency", "ads", f"WITH {FACTS} SELECT ad_id, frequency FROM facts", heavy=True)
def rx4(ads: DataFrame) -> DataFrame:
    return salary_facts(ads).select("ad_id", "frequency")


@register(
    "rx5_resolve_range", "ads",
    f"WITH {FACTS} SELECT ad_id, min3 AS min, max3 AS max, currency FROM facts",
    heavy=True,
)
def rx5(ads: DataFrame) -> DataFrame:
    ends = [F.col(c) for c in ("min1", "max1", "min2", "max2")]
    resolved = R.resolve_range(F.col("nation_short_desc"), *ends)
    return salary_facts(ads).select("ad_id", resolved.alias("r")).select("ad_id", "r.*")


@register(
    "rx6_format_salary", "ads",
    "SELECT ad_id, CASE WHEN ad_id % 11 <> 0 THEN concat(ad_id % 11, '-', ad_id, '-', nation_short_desc, '-', "
    "CASE WHEN ad_id % 4 = 0 THEN 'None' ELSE 'WEEKLY' END) ELSE '0-0-None-None' END AS salary FROM ads",
)
def rx6(ads: DataFrame) -> DataFrame:
    frequency = F.when(F.col("ad_id") % 4 != 0, "WEEKLY")
    return ads.select(
        "ad_id",
        R.format_salary(
            F.col("ad_id") % 11, F.col("ad_id"), F.col("nation_short_desc"), frequency
        ).alias("salary"),
    )


@register(
    "rx7_salary_facts", "ads",
    f"WITH {FACTS} SELECT ad_id, {C.strip('y_true')} AS y_true, y_pred FROM facts",
    heavy=True,
)
def rx7(ads: DataFrame) -> DataFrame:
    return salary_facts(ads).select("ad_id", strip(F.col("y_true")).alias("y_true"), "y_pred")


@register(
    "rx7_salary_accuracy", "ads",
    f"WITH {FACTS} SELECT round(avg(({C.strip('y_true')} = y_pred)::INTEGER), 6) AS accuracy FROM facts",
    heavy=True,
)
def rx7_accuracy(ads: DataFrame) -> DataFrame:
    facts = salary_facts(ads).withColumn("y_true", strip(F.col("y_true")))
    return E.accuracy(facts, truth="y_true").select(F.round("accuracy", 6).alias("accuracy"))


ARRANGEMENT = f"""arranged AS (SELECT *,
  CASE WHEN ({C.any_of("lower(job_ad_details)", K.REMOTE_PHRASES)})
      AND ({C.any_of("lower(job_ad_details)", K.ONSITE_PHRASES)}) THEN 'Hybrid'
    WHEN {C.any_of("lower(job_ad_details)", K.HYBRID_PHRASES)} THEN 'Hybrid'
    WHEN {C.any_of("lower(job_ad_details)", K.REMOTE_PHRASES)} THEN 'Remote'
    ELSE 'Onsite' END AS arrangement FROM ads)"""


@register("rx8_arrangement", "ads", f"WITH {ARRANGEMENT} SELECT ad_id, arrangement FROM arranged", heavy=True)
def rx8(ads: DataFrame) -> DataFrame:
    return ads.select("ad_id", R.arrangement(F.col("job_ad_details")).alias("arrangement"))


@register(
    "rx8_arrangement_counts", "ads",
    f"""WITH {ARRANGEMENT} SELECT arrangement, count(*) AS ads,
  round(avg((arrangement = arrangement_true)::INTEGER), 6) AS accuracy FROM arranged GROUP BY 1""",
    heavy=True,
)
def rx8_counts(ads: DataFrame) -> DataFrame:
    found = ads.withColumn("arrangement", R.arrangement(F.col("job_ad_details")))
    right = (F.col("arrangement") == F.col("arrangement_true")).cast("int")
    return found.groupBy("arrangement").agg(
        F.count(F.lit(1)).alias("ads"), F.round(F.avg(right), 6).alias("accuracy")
    )
