import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adfacts.sources import records as R
from adfacts.sources import tables as S

AB = StructType([StructField(n, StringType()) for n in "ab"])


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_one_task(spark, path):
    rows = spark.read.options(**S.CSV, multiLine=True).csv(path)
    return sorted((tuple(r) for r in rows.select("a", "b").collect()), key=str)


def by_split(spark, path):
    return sorted((tuple(r) for r in S.read_csv(spark, path, AB).collect()), key=str)


PLAIN = 'b,a,c\n1,2,3\n"x\ny","q ""q""\n\n,z",\n,"",\né,"日本\n😀, ""\n""\n",w\n" s ", t ,\n'


def test_every_split_position_gives_the_same_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(PLAIN)
    want = by_one_task(spark, str(tmp_path / "a.csv"))
    assert len(want) == 5
    # One byte cuts at every position.
    for size in (1, 2, 3, 7, 16, 50, len(PLAIN.encode())):
        small_splits(size)
        assert by_split(spark, str(tmp_path / "a.csv")) == want, size


def test_random_files_of_a_folder(spark, tmp_path, small_splits):
    rng = random.Random(5)
    for i in range(4):
        rows = []
        for _ in range(60):
            cells = ["".join(rng.choices('ab,"\n\r \\é', k=rng.randrange(0, 9))) for _ in range(3)]
            rows.append(",".join('"' + c.replace('"', '""') + '"' for c in cells))
        text = ("﻿" if i == 1 else "") + "a,x,b\n" + "\n".join(rows) + ("\n" if i % 2 else "")
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    want = by_one_task(spark, str(tmp_path))
    assert len(want) == 240
    for size in (61, 1000, 1 << 20):
        small_splits(size)
        assert by_split(spark, str(tmp_path)) == want, size


def test_as_many_tasks_as_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n" + '"one\ntwo",x\n' * 1000)
    small_splits(1000)
    rows = S.read_csv(spark, str(tmp_path / "a.csv"), AB)
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert rows.count() == 1000 and used >= 12
    assert rows.distinct().collect() == [("one\ntwo", "x")]


def test_ends_of_lines_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n\n2,3\r\n4,5')
    assert by_split(spark, str(tmp_path / "a.csv")) == [("1", "x\r\ny"), ("2", "3"), ("4", "5")]


def test_quotes_that_cannot_be_paired_are_errors(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('a,b\n1,"2\n')
    with pytest.raises(PySparkException, match="quotes are not paired"):
        S.read_csv(spark, str(tmp_path / "odd.csv"), AB).collect()
    (tmp_path / "loose.csv").write_text('a,b\n5" tv,1\n6" tv,2\n')
    with pytest.raises(PySparkException, match="a quote outside"):
        S.read_csv(spark, str(tmp_path / "loose.csv"), AB).collect()


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(PySparkException, match="another header"):
        S.read_csv(spark, str(tmp_path), AB).collect()


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n")
    (tmp_path / "2.csv").write_text("")
    assert S.read_csv(spark, str(tmp_path), AB).collect() == []


def test_arrays_over_the_limit_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"prompt": "p", "complete": "c"}]')
    assert S.read_records(spark, str(tmp_path), S.PAIRS, one_array=True).count() == 1
    with pytest.raises(ValueError, match="a.json is an array of 34 bytes"):
        S.read_records(spark, str(tmp_path), S.PAIRS, one_array=True, largest=33)


def test_no_text_is_shuffled_but_at_split_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text(PLAIN)
    whole = R.csv_records(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    union = whole.split("Union")[1]
    assert "Exchange hashpartitioning(file" in union and union.count("Exchange hashpartitioning") <= 2
