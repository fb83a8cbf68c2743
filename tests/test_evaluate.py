import random

import pytest
from pyspark.sql import functions as F

from adfacts.operators import evaluate as E

MARK = {"Salary": "[TASK: Salary]", "Seniority": "[TASK: Seniority]", "Unknown": "nothing"}


def rows(n=400):
    random.seed(3)
    out = []
    for i in range(n):
        task = random.choice(list(MARK))
        if task == "Salary":
            answers = ["1000-2000-AUD-MONTHLY", "0-0-None-None", "300-400-SGD-ANNUAL"]
        else:
            answers = ["senior", "lead", "junior"]
        true = random.choice(answers)
        pred = random.choice([*answers, "other", None, f"{true} indeed", "20-30-AUD-HOURLY"])
        out.append((i, f"m{i % 3}", MARK[task], true, pred))
    return out


def brute(pairs):
    labels = {t for t, _ in pairs} | {p for _, p in pairs if p is not None}
    recalls, f1s = [], []
    for label in labels:
        hits = sum(t == p == label for t, p in pairs)
        support = sum(t == label for t, _ in pairs)
        predicted = sum(p == label for _, p in pairs)
        recalls.append(hits / support if support else 0)
        f1s.append(2 * hits / (support + predicted))
    return sum(recalls) / len(labels), sum(f1s) / len(labels)


@pytest.fixture(scope="module")
def results(spark):
    schema = "row_id int, model string, prompt string, complete string, y_pred string"
    return spark.createDataFrame(rows(), schema).cache()


def test_macro_scores(results):
    (all_rows,) = E.macro_scores(results).collect()
    want = brute([(t, p) for *_, t, p in rows()])
    assert tuple(all_rows) == pytest.approx(want)
    for r in E.macro_scores(results, ["model"]).collect():
        want = brute([(t, p) for _, m, _, t, p in rows() if m == r["model"]])
        assert (r["macro_recall"], r["macro_f1"]) == pytest.approx(want)


def test_task_scores_and_accuracy(results):
    got = {r["task_type"]: (r["correct"], r["total"]) for r in E.task_scores(results).collect()}
    for task in ("Salary", "Seniority"):
        mine = [(t, p) for _, _, prompt, t, p in rows() if prompt == MARK[task]]
        assert got[task] == (sum(t == p for t, p in mine), len(mine))
    assert "Unknown" not in got
    (acc,) = E.accuracy(results).collect()
    assert acc["accuracy"] == pytest.approx(sum(t == p for *_, t, p in rows()) / 400)


def test_salary_parts_count_missing_as_wrong(spark):
    data = [
        ("[TASK: Salary]", "1000-2000-AUD-MONTHLY", "so 1000-2500-AUD-MONTHLY ok"),
        ("[TASK: Salary]", "0-0-None-None", None),
        ("[TASK: Salary]", "20-30-AUD-HOURLY", "20-30-AUD-HOURLY"),
        ("[TASK: Salary]", "20-30-AUD-HOURLY", "a-b-c-d-e"),
        ("[TASK: Seniority]", "x", "x"),
    ]
    df = spark.createDataFrame(data, "prompt string, complete string, y_pred string")
    (found,) = E.salary_part_scores(df).collect()
    # A missing answer reads as no salary, two-digit pay is never found.
    assert tuple(found) == (0.5, 0.25, 0.5, 0.5, 0.4375)
    (strict,) = E.salary_part_scores(df, strict=True).collect()
    assert tuple(strict)[:4] == (0.25, 0.25, 0.5, 0.25)


def test_report_agrees_with_its_parts(results):
    report = {r["model"]: r for r in E.report(results).collect()}
    accuracy = {r["model"]: r["accuracy"] for r in E.accuracy(results, ["model"]).collect()}
    parts = {r["model"]: r for r in E.salary_part_scores(results, ["model"]).collect()}
    assert set(report) == {"m0", "m1", "m2"}
    for model, r in report.items():
        assert r["accuracy"] == pytest.approx(accuracy[model])
        assert r["mean_accuracy"] == pytest.approx(parts[model]["mean_accuracy"])
    assert sum(r["rows"] for r in report.values()) == results.count()


def test_report_keeps_every_model(spark):
    data = [
        (None, "[TASK: Seniority]", "a", "a"), ("m", "[TASK: Seniority]", "a", "b"),
        ("n", "[TASK: Salary]", None, None),
    ]
    df = spark.createDataFrame(data, "model string, prompt string, complete string, y_pred string")
    report = {r["model"]: r for r in E.report(df).collect()}
    assert set(report) == {None, "m", "n"}
    assert report[None]["macro_f1"] == 1 and report["n"]["macro_f1"] is None
    (whole,) = E.report(df, keys=()).collect()
    assert whole["rows"] == 3 and whole["accuracy"] == pytest.approx(1 / 3)


def test_position_sections(spark):
    from adfacts.operators import pairs as P

    df = spark.range(0, 20).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 4 == 0, "[TASK: Salary] [TASK: Seniority]").otherwise("x").alias("prompt"),
    )
    assert P.rows_between(df, 5, 8).count() == 3
    assert {(r["task_type"], r["row_id"]) for r in P.preview(df, 2).collect()} == {
        ("Salary", 0), ("Salary", 4), ("Unknown", 1), ("Unknown", 2),
    }
    assert {tuple(r) for r in P.first_rows(df.filter("row_id > 1")).collect()} == {
        ("Salary", 4), ("Seniority", 4),
    }
