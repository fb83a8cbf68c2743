"""Queries over answer cleaning, checking and choosing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import answers as A
from adfacts.operators import verify as V
from adfacts.plans import checksql as C
from adfacts.plans.registry import register

TEXT = {
    "direct": f"CASE WHEN length(raw) > 1 THEN {C.strip('raw')} END",
    "chain": f"CASE WHEN contains(raw, 'Output:') THEN {C.strip('''string_split(raw, 'Output:')[2]''')} END",
}


def _salary(text: str) -> str:
    found = rf"regexp_extract({text}, '(\d+-\d+-[A-Z]+-[A-Z]+|0-0-None-None)')"
    return f"coalesce(nullif({found}, ''), '0-0-None-None')"


def _seniority(text: str, mode: str) -> str:
    labels = sorted(K.SENIORITY_LABELS + ["unknown"] * (mode == "chain"), key=lambda s: -len(s))
    entry = "entry level" if mode == "direct" else "entry-level"
    low = f"lower({text})"
    return f"""coalesce(list_filter({C.listed(labels)}, lambda l: contains({low}, l))[1],
      CASE WHEN contains({low}, 'entry') AND contains({low}, 'level') THEN '{entry}'
        WHEN contains({low}, 'mid') AND contains({low}, 'level') THEN 'mid-level' ELSE 'Unknown' END)"""


def _arrangement(text: str) -> str:
    return f"""CASE lower(regexp_extract({text}, '(?i)(onsite|hybrid|remote)'))
      WHEN 'onsite' THEN 'OnSite' WHEN 'hybrid' THEN 'Hybrid' WHEN 'remote' THEN 'Remote' ELSE 'Unknown' END"""


def _cleaned(mode: str) -> str:
    text = TEXT[mode]
    return f"""CASE task_type WHEN 'Salary' THEN {_salary(text)} WHEN 'Seniority' THEN {_seniority(text, mode)}
      WHEN 'Work Arrangement' THEN {_arrangement(text)} ELSE raw END"""


def _valid_salary(x: str) -> str:
    part = [f"string_split({C.strip(x)}, '-')[{i}]" for i in range(1, 5)]
    return f"""coalesce(len(string_split({C.strip(x)}, '-')) = 4
      AND try_cast({part[0]} AS HUGEINT) >= 0 AND try_cast({part[1]} AS HUGEINT) >= try_cast({part[0]} AS HUGEINT)
      AND list_contains({C.listed(K.CURRENCIES)}, {part[2]})
      AND list_contains({C.listed(K.FREQUENCIES)}, {part[3]}), false)"""


def _valid_seniority(x: str) -> str:
    return f"coalesce(list_contains({C.listed(K.SENIORITY_LABELS)}, {C.strip(x)}), false)"


def _valid_arrangement(x: str) -> str:
    return f"coalesce({C.strip(x)} IN ('OnSite', 'Remote', 'Hybrid'), false)"


CHECKED = f"""cleaned AS (SELECT *, {_cleaned("direct")} AS cleaned FROM attempts),
checked AS (SELECT *, CASE WHEN raw IS NULL THEN false ELSE CASE task_type
  WHEN 'Salary' THEN {_valid_salary("cleaned")}
  WHEN 'Seniority' THEN {_valid_seniority("cleaned")}
  WHEN 'Work Arrangement' THEN {_valid_arrangement("cleaned")} ELSE false END END AS valid FROM cleaned)"""
CHOSEN = f"""{CHECKED},
firsts AS (SELECT prompt_id, min(attempt) FILTER (valid AND attempt <= 5) AS f FROM checked GROUP BY 1),
chosen AS (SELECT prompt_id,
  coalesce(max(cleaned) FILTER (attempt = f), max(cleaned) FILTER (attempt = 6)) AS answer,
  bool_or(f IS NOT NULL) AS accepted,
  (count(*) FILTER (NOT valid AND attempt < least(coalesce(f, 6), 6)))::INTEGER AS re_attempts
FROM checked JOIN firsts USING (prompt_id) GROUP BY 1)"""


def _both_modes(df: DataFrame, clean, *keys: str) -> DataFrame:
    return df.select(*keys, *[clean(F.col("raw"), mode).alias(mode) for mode in TEXT])


@register(
    "vf1_answer_text", "attempts",
    f"SELECT prompt_id, attempt, {TEXT['direct']} AS direct, {TEXT['chain']} AS chain FROM attempts",
)
def vf1(attempts: DataFrame) -> DataFrame:
    return _both_modes(attempts, A.answer_text, "prompt_id", "attempt")


@register(
    "vf2_clean_salary", "attempts",
    f"SELECT prompt_id, attempt, {_salary(TEXT['direct'])} AS direct, {_salary(TEXT['chain'])} AS chain FROM attempts",
    heavy=True,
)
def vf2(attempts: DataFrame) -> DataFrame:
    return _both_modes(attempts, A.clean_salary, "prompt_id", "attempt")


@register(
    "vf3_clean_seniority", "attempts",
    f"""SELECT prompt_id, attempt, {_seniority(TEXT['direct'], 'direct')} AS direct,
  {_seniority(TEXT['chain'], 'chain')} AS chain FROM attempts""",
    heavy=True,
)
def vf3(attempts: DataFrame) -> DataFrame:
    return _both_modes(attempts, A.clean_seniority, "prompt_id", "attempt")


@register(
    "vf3_clean_seniority_predictions", "predictions",
    f"""SELECT row_id, {_seniority(TEXT['direct'], 'direct')} AS direct,
  {_seniority(TEXT['chain'], 'chain')} AS chain FROM (SELECT row_id, y_pred AS raw FROM predictions)""",
    heavy=True,
)
def vf3_predictions(predictions: DataFrame) -> DataFrame:
    return _both_modes(
        predictions.withColumnRenamed("y_pred", "raw"), A.clean_seniority, "row_id"
    )


@register(
    "vf4_clean_arrangement", "attempts",
    f"""SELECT prompt_id, attempt, {_arrangement(TEXT['direct'])} AS direct,
  {_arrangement(TEXT['chain'])} AS chain FROM attempts""",
    heavy=True,
)
def vf4(attempts: DataFrame) -> DataFrame:
    return _both_modes(attempts, A.clean_arrangement, "prompt_id", "attempt")


@register(
    "vf5_valid_salary", "attempts",
    f"SELECT prompt_id, attempt, {_valid_salary('raw')} AS raw_valid, {_valid_salary('cleaned')} AS valid "
    f"FROM (SELECT *, {_salary(TEXT['direct'])} AS cleaned FROM attempts)",
    heavy=True,
)
def vf5(attempts: DataFrame) -> DataFrame:
    return attempts.select(
        "prompt_id", "attempt",
        A.valid_salary(F.col("raw")).alias("raw_valid"),
        A.valid_salary(A.clean_salary(F.col("raw"))).alias("valid"),
    )


@register(
    "vf6_valid_seniority", "attempts",
    f"SELECT prompt_id, attempt, {_valid_seniority('cleaned')} AS valid "
    f"FROM (SELECT *, {_seniority(TEXT['direct'], 'direct')} AS cleaned FROM attempts)",
    heavy=True,
)
def vf6(attempts: DataFrame) -> DataFrame:
    valid = A.valid_seniority(A.clean_seniority(F.col("raw")))
    return attempts.select("prompt_id", "attempt", valid.alias("valid"))


@register(
    "vf7_valid_arrangement", "predictions",
    f"SELECT row_id, {_valid_arrangement('complete')} AS valid, "
    "complete IN ('Onsite', 'Remote', 'Hybrid') AS valid_lower_case FROM predictions",
)
def vf7(predictions: DataFrame) -> DataFrame:
    answer = F.col("complete")
    return predictions.select(
        "row_id",
        A.valid_arrangement(answer).alias("valid"),
        A.valid_arrangement(answer, "Onsite").alias("valid_lower_case"),
    )


@register(
    "vf8_checked_attempts", "attempts",
    f"WITH {CHECKED} SELECT prompt_id, attempt, cleaned, valid FROM checked",
    heavy=True,
)
def vf8_checked(attempts: DataFrame) -> DataFrame:
    return V.checked(attempts).select("prompt_id", "attempt", "cleaned", "valid")


@register(
    "vf8_first_valid", "attempts",
    f"WITH {CHOSEN} SELECT prompt_id, answer, accepted, re_attempts FROM chosen",
    heavy=True,
)
def vf8(attempts: DataFrame) -> DataFrame:
    return V.first_valid(V.checked(attempts))


@register(
    "vf9_re_attempts", "attempts",
    f"WITH {CHOSEN} SELECT sum(re_attempts)::BIGINT AS re_attempts FROM chosen",
    heavy=True,
)
def vf9(attempts: DataFrame) -> DataFrame:
    return V.total_re_attempts(V.first_valid(V.checked(attempts)))


def _stand_in(attempt: int):
    """A model that answers well only when the prompt's length and the attempt fit."""

    def make():
        def answer(prompts: list[str]) -> list[str]:
            return [
                "it pays 100-900-AUD-MONTHLY" if (len(p) + attempt) % 7 == 0 else "900-100-AUD-MONTHLY"
                for p in prompts
            ]

        return answer

    return make


@register(
    "vf8_attempt_until_valid", "pairs",
    """WITH n AS (SELECT pair_id, 7 - (length(prompt) + 15) % 7 AS a FROM pairs)
SELECT pair_id AS prompt_id, CASE WHEN a <= 6 THEN '100-900-AUD-MONTHLY' ELSE '900-100-AUD-MONTHLY' END AS answer,
  a <= 5 AS accepted, (least(a, 6) - 1)::INTEGER AS re_attempts FROM n""",
)
def vf8_rounds(pairs: DataFrame) -> DataFrame:
    prompts = pairs.select(
        F.col("pair_id").alias("prompt_id"),
        F.concat(F.lit("[TASK: Salary] "), "prompt").alias("prompt"),
    )
    return V.first_valid(V.attempt_until_valid(prompts, _stand_in))
