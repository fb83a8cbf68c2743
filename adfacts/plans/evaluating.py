"""Queries over the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.functions import answers as A
from adfacts.operators import evaluate as E
from adfacts.plans import checksql as C
from adfacts.plans.registry import register

FOUND = r"""coalesce(nullif(regexp_extract(y_pred, '\d{3,6}-\d{3,6}-[A-Z]{3,4}-[A-Z]+'), ''), '0-0-None-None')"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(
    "ev1_task_scores", "predictions",
    f"""WITH t AS (SELECT *, {C.task_type("prompt")} AS task_type FROM predictions)
SELECT task_type, count(*) FILTER (complete = y_pred) AS correct, count(*) AS total,
  round(count(*) FILTER (complete = y_pred) / count(*) * 100, 6) AS percent
FROM t WHERE task_type <> 'Unknown' GROUP BY 1""",
)
def ev1(predictions: DataFrame) -> DataFrame:
    return _rounded(E.task_scores(predictions), "percent")


@register(
    "ev2_accuracy", "predictions",
    "SELECT round(avg((complete = y_pred)::INTEGER), 6) AS accuracy FROM predictions",
)
def ev2(predictions: DataFrame) -> DataFrame:
    return _rounded(E.accuracy(predictions), "accuracy")


def macro_sql(table: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    return f"""names AS (SELECT {by}complete AS label FROM {table} UNION SELECT {by}y_pred FROM {table}),
true_counts AS (SELECT {by}complete AS label, count(*) AS s, count(*) FILTER (complete = y_pred) AS h
  FROM {table} GROUP BY ALL),
pred_counts AS (SELECT {by}y_pred AS label, count(*) AS p FROM {table} GROUP BY ALL),
per_label AS (SELECT {by}label, coalesce(h, 0) AS h, coalesce(s, 0) AS s, coalesce(p, 0) AS p
  FROM names LEFT JOIN true_counts USING ({by}label) LEFT JOIN pred_counts USING ({by}label)
  WHERE label IS NOT NULL),
macro AS (SELECT {by}avg(CASE WHEN s > 0 THEN h / s ELSE 0 END) AS macro_recall,
  avg(2 * h / (s + p)) AS macro_f1 FROM per_label {"GROUP BY " + keys if keys else ""})"""


@register(
    "ev3_macro_recall", "predictions",
    f"WITH {macro_sql('predictions')} SELECT round(macro_recall, 6) AS macro_recall FROM macro",
)
def ev3(predictions: DataFrame) -> DataFrame:
    return _rounded(E.macro_scores(predictions).select("macro_recall"), "macro_recall")


@register(
    "ev4_macro_f1", "predictions",
    f"WITH {macro_sql('predictions')} SELECT round(macro_f1, 6) AS macro_f1 FROM macro",
)
def ev4(predictions: DataFrame) -> DataFrame:
    return _rounded(E.macro_scores(predictions).select("macro_f1"), "macro_f1")


@register(
    "ev4_label_scores", "predictions",
    f"""WITH {macro_sql('predictions')}
SELECT label, s::BIGINT AS support, p::BIGINT AS predicted, h::BIGINT AS hits FROM per_label""",
)
def ev4_labels(predictions: DataFrame) -> DataFrame:
    return E.label_scores(predictions)


@register(
    "ev4_quality_labels", "quality",
    f"""WITH {macro_sql('quality')} SELECT round(macro_recall, 6) AS macro_recall,
  round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy
FROM macro, (SELECT avg((complete = y_pred)::INTEGER) AS accuracy FROM quality)""",
)
def ev4_quality(quality: DataFrame) -> DataFrame:
    scores = E.macro_scores(quality).withColumn("accuracy", E.accuracy(quality).scalar())
    return _rounded(scores, "macro_recall", "macro_f1", "accuracy")


@register("ev5_reported_salary", "predictions", f"SELECT row_id, {FOUND} AS salary FROM predictions")
def ev5(predictions: DataFrame) -> DataFrame:
    return predictions.select("row_id", A.reported_salary(F.col("y_pred")).alias("salary"))


def _parts(x: str) -> str:
    names = ("min", "max", "currency", "frequency")
    return ", ".join(
        f"CASE WHEN contains({x}, '-') THEN {C.strip(f'''string_split({x}, '-')[{i}]''')} END AS {n}"
        for i, n in enumerate(names, 1)
    )


@register("ev6_salary_parts", "predictions", f"SELECT row_id, {_parts('y_pred')} FROM predictions")
def ev6(predictions: DataFrame) -> DataFrame:
    parts = A.salary_parts(F.col("y_pred"))
    return predictions.select("row_id", parts.alias("p")).select("row_id", "p.*")


PART_COLUMNS = [f"{p}_accuracy" for p in E.PARTS] + ["mean_accuracy"]


def _part_hits(found: str) -> str:
    return ", ".join(
        f"avg(coalesce(({found})[{i}] = string_split(complete, '-')[{i}], false)::INTEGER) AS {p}_accuracy"
        for i, p in enumerate(E.PARTS, 1)
    )


_MEAN = "(min_accuracy + max_accuracy + currency_accuracy + frequency_accuracy) / 4"
_ROUNDED_PARTS = ", ".join(f"round({p}_accuracy, 6) AS {p}_accuracy" for p in E.PARTS)
STRICT = """CASE WHEN len(string_split(y_pred, '-')) BETWEEN 2 AND 4 THEN string_split(y_pred, '-') END"""


@register(
    "ev7_salary_part_scores", "predictions",
    f"""WITH a AS (SELECT {_part_hits(f"string_split({FOUND}, '-')")} FROM predictions
  WHERE {C.task_type("prompt")} = 'Salary')
SELECT {_ROUNDED_PARTS}, round({_MEAN}, 6) AS mean_accuracy FROM a""",
    heavy=True,
)
def ev7(predictions: DataFrame) -> DataFrame:
    return _rounded(E.salary_part_scores(predictions), *PART_COLUMNS)


@register(
    "ev8_strict_part_scores", "predictions",
    f"""WITH a AS (SELECT {_part_hits(STRICT)} FROM predictions
  WHERE {C.task_type("prompt")} = 'Salary')
SELECT {_ROUNDED_PARTS}, round({_MEAN}, 6) AS mean_accuracy FROM a""",
)
def ev8(predictions: DataFrame) -> DataFrame:
    return _rounded(E.salary_part_scores(predictions, strict=True), *PART_COLUMNS)


@register(
    "ev9_exact_match", "predictions",
    f"""SELECT model, {C.task_type("prompt")} AS task_type,
  count(*) FILTER (complete = y_pred) AS correct, count(*) AS total,
  round(count(*) FILTER (complete = y_pred) / count(*) * 100, 6) AS percent
FROM predictions WHERE {C.task_type("prompt")} <> 'Unknown' GROUP BY 1, 2""",
)
def ev9(predictions: DataFrame) -> DataFrame:
    return _rounded(E.task_scores(predictions, ["model"]), "percent")


_TASKS = ("Salary", "Seniority", "Work Arrangement")
_TASK_SQL = ", ".join(
    f"count(*) FILTER (task_type = '{t}' AND complete = y_pred) AS {n}_correct, "
    f"count(*) FILTER (task_type = '{t}') AS {n}_total"
    for t, n in ((t, t.lower().replace(" ", "_")) for t in _TASKS)
)
def report_sql(table: str) -> str:
    """The report per model; '?' stands for a null model until the end, as joins need a value."""
    return f"""WITH typed AS (SELECT * REPLACE (coalesce(model, '?') AS model), {C.task_type("prompt")} AS task_type
  FROM {table}),
counted AS (SELECT model, count(*) AS rows, round(avg(coalesce(complete = y_pred, false)::INTEGER), 6) AS accuracy,
  {_TASK_SQL} FROM typed GROUP BY 1),
part_hits AS (SELECT model, {_part_hits(f"string_split({FOUND}, '-')")} FROM typed
  WHERE task_type = 'Salary' GROUP BY 1),
{macro_sql("typed", "model")}
SELECT counted.* REPLACE (nullif(counted.model, '?') AS model), {_ROUNDED_PARTS},
  round({_MEAN}, 6) AS mean_accuracy, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1
FROM counted LEFT JOIN part_hits USING (model) LEFT JOIN macro USING (model)"""


REPORT_SQL = report_sql("predictions")


def rounded_report(results: DataFrame) -> DataFrame:
    return _rounded(E.report(results), "accuracy", *PART_COLUMNS, "macro_recall", "macro_f1")


@register("ev10_report", "predictions", REPORT_SQL, heavy=True)
def ev10(predictions: DataFrame) -> DataFrame:
    return rounded_report(predictions)


@register("ev10_report_gappy", "gappy_predictions", report_sql("gappy_predictions"), heavy=True)
def ev10_gappy(predictions: DataFrame) -> DataFrame:
    return rounded_report(predictions)
