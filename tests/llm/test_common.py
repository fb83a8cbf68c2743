import os
import zlib

import pytest
from pyspark.sql import functions as F

from adfacts.llm import common as C


def folders(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    own = f"{root}/adfacts/{spark.sparkContext.applicationId}"
    return set(os.listdir(own)) if os.path.isdir(own) else set()


def test_settled_keeps_only_the_result(spark):
    before = folders(spark)

    def build():
        inner = C.settled(spark, lambda: C.written(spark.range(5), "low").filter("id > 1"), "inner")
        return C.written(inner.selectExpr("id * 2 as id"), "middle").filter("id < 8")

    out = C.settled(spark, build, "outer")
    assert sorted(r["id"] for r in out.collect()) == [4, 6]
    (left,) = folders(spark) - before
    assert left.startswith("outer-")


def test_scratch_is_deleted_after_an_error(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError, match="stop"), C.scratch(spark):
        C.written(spark.range(3), "gone")
        raise RuntimeError("stop")
    assert folders(spark) == before


@pytest.mark.parametrize("rows", [100, 1])
def test_group_values_reach_null_keys_by_broadcast_and_by_key(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "g string, n int")
    groups = spark.createDataFrame([("a", 10), (None, 20)], "g string, v int")
    out = C.with_group_values(df, groups, ["g"])
    assert out.columns == ["g", "n", "v"]
    assert {tuple(r) for r in out.collect()} == {("a", 1, 10), (None, 2, 20), ("c", 3, None)}


def test_decisions_by_id_and_text(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a"), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.filter("doc_id = 1 and text = 'a' or doc_id is null and text is null")
    keys = keys.select("doc_id", C.text_key().alias("k"))
    out = C.decided(docs, keys, "left_anti", C.text_key())
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        map(str, [(1, "b"), (None, "a"), (2, "a"), (2, "a")])
    )
    assert C.decided(docs, keys, "left_semi", C.text_key()).count() == 2


def test_fold_and_lower_case(spark):
    df = spark.createDataFrame([(7, "AbÉ\u212a"), (None, None)], "doc_id long, t string")
    out = df.select(C.fold("doc_id", 7).alias("f"), C.lowered(F.col("t")).alias("t")).collect()


    assert out[0]["f"] == zlib.crc32(b"7") % 7 and out[1]["f"] == -1
    assert out[0]["t"].startswith("abé") and "k" not in out[0]["t"] and out[1]["t"] is None
    assert C.words("A-b\x00c\x85 É9_k".encode()) == ["a".encode(), b"b", "c\x85".encode(), "É9".encode(), b"k"]
