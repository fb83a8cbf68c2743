import json

import pytest

from adfacts.operators import pairs as P
from adfacts.sources import tables as S
from adfacts.streaming.ads import ad_stream, write_salary_facts

ADS = [
    ('He said "hi", ok', "<p>line one\nline two</p>", "AUS", " 10-20 per hour ", "None"),
    ("é 日本 😀", "a\\b,c", None, None, "0-0-None-None"),
    ("last", "<h3>Compensation</h3><p>700</p>", "SG", "x", "y"),
]


def test_csv_round_trip_keeps_every_character(spark, tmp_path):
    df = spark.createDataFrame(ADS, S.SALARY_ADS)
    S.write_csv(df, str(tmp_path / "ads"), *S.SALARY_ADS.names)
    back = S.read_csv(spark, str(tmp_path / "ads"), S.SALARY_ADS)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ADS, key=str)


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    df = spark.createDataFrame([(7, *row) for row in ADS], "job_id int, " + ", ".join(f"{n} string" for n in S.SALARY_ADS.names))
    S.write_csv(df, str(tmp_path / "more"), "job_id", *reversed(S.SALARY_ADS.names))
    back = S.read_csv(spark, str(tmp_path / "more"), S.SALARY_ADS)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ADS, key=str)
    S.write_csv(df, str(tmp_path / "less"), "job_id", "job_title")
    with pytest.raises(ValueError, match="no column job_ad_details"):
        S.read_csv(spark, str(tmp_path / "less"), S.SALARY_ADS)


def test_all_ad_tables_read_by_their_schema(spark, tmp_path):
    for name, schema in (("seniority", S.SENIORITY_ADS), ("arrangement", S.ARRANGEMENT_ADS)):
        rows = [tuple(f"{c}\n{i}" for c in schema.names) for i in range(3)]
        lines = [",".join(schema.names)] + [",".join(f'"{v}"' for v in r) for r in rows]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        back = S.read_csv(spark, str(tmp_path / f"{name}.csv"), schema)
        assert sorted(map(tuple, back.collect())) == rows
    record = {"prompt": "p", "complete": "Remote", "task_type": "work_arrangement", "other": 1}
    (tmp_path / "multi.json").write_text(json.dumps([record]))
    tasks = S.read_records(spark, str(tmp_path / "multi.json"), S.TASK_PAIRS, one_array=True)
    assert [tuple(r) for r in tasks.collect()] == [("p", "Remote", "work_arrangement")]


def test_json_array_and_lines(spark, tmp_path):
    records = [{"prompt": "é 1", "complete": "None"}, {"prompt": None, "complete": "2"}]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2, ensure_ascii=False))
    df = S.read_records(spark, str(tmp_path / "a.json"), S.PAIRS, one_array=True)
    assert [tuple(r) for r in df.collect()] == [("é 1", "None"), (None, "2")]
    for ascii_only in (False, True):
        path = tmp_path / f"lines-{ascii_only}"
        S.write_records(df.coalesce(1), str(path), ascii_only)
        text = "".join(p.read_text() for p in path.glob("part-*"))
        assert ("\\u00e9" in text.lower()) is ascii_only
        assert S.read_records(spark, str(path), S.PAIRS).collect() == df.collect()


def test_results_take_the_model_from_the_file(spark, tmp_path):
    one = [{"prompt": "p", "complete": "a", "y_pred": "a", "inference_time": 0.5}]
    two = [{"prompt": "p", "y_true": "a", "y_predicted": "b"}]
    (tmp_path / "model one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps(two))
    (tmp_path / "notes.txt").write_text("not a result")
    out = S.read_results(spark, str(tmp_path), one_array=True)
    assert {(r["model"], r["complete"], r["y_pred"]) for r in out.collect()} == {
        ("model one", "a", "a"), ("two", "a", "b"),
    }


def test_harmonised_and_pairs(spark):
    df = spark.createDataFrame([("p", "a", "b")], "prompt string, y_true string, y_predicted string")
    assert P.harmonised(df).columns == ["prompt", "complete", "y_pred"]
    assert P.harmonised(P.harmonised(df)).columns == ["prompt", "complete", "y_pred"]
    rows = [("a", "b"), ("", "b"), ("a", ""), (None, "b"), ("a", None)]
    df = spark.createDataFrame(rows, "prompt string, complete string")
    assert P.both_sides(df).collect() == [("a", "b")]
    assert [r["prompt"] for r in P.as_text(df).collect()] == ["a", "", "a", "", "a"]


@pytest.mark.parametrize("files", [2])
def test_a_stream_of_ads_gives_the_same_facts(spark, tmp_path, files):
    from adfacts.operators.salary import salary_facts

    df = spark.createDataFrame(ADS, S.SALARY_ADS).repartition(files)
    S.write_csv(df, str(tmp_path / "in"), *S.SALARY_ADS.names)
    stream = ad_stream(spark, str(tmp_path / "in"), S.SALARY_ADS)
    for _ in range(2):  # the second run finds nothing new
        write_salary_facts(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = salary_facts(df)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
