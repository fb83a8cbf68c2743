"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.session import new_folder

# A-Z to a-z; every other ASCII character but digits and a-z to a blank; bytes of longer
# UTF-8 sequences stay, as they all belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Begins the names of columns that are added to documents for a while.
OWN = "_llm_"
# The largest table that is broadcast, in rows of a key and a few numbers.
BROADCAST_ROWS = 100_000


def words(text: bytes | None) -> list[bytes]:
    """The lower-case words of a UTF-8 text; none of a null."""
    return text.translate(WORD_BYTES).split() if text else []


def lowered(text: Column) -> Column:
    """``text`` in lower case, such that no ASCII letter comes of any other than A-Z.

    The Kelvin sign is the only other character whose lower case is one ASCII letter.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of whole texts that a Python worker holds at once while a table is written.
BATCH_SIZE, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
# Paths written since each open ``scratch`` began.
_spent: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end."""
    _spent.append([])
    try:
        yield
    finally:
        for path in _spent.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write(df: DataFrame, name: str) -> str:
    """The folder of the written rows. Python workers get at most ``BATCH`` rows at a time."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(BATCH_SIZE)
    spark.conf.set(BATCH_SIZE, min(int(before), BATCH) if int(before) > 0 else BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_SIZE, before)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there."""
    path = _write(df, name)
    if _spent:
        _spent[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``build()``, written; tables it wrote on the way are deleted."""
    with scratch(spark):
        result = build()
        path = _write(result, name)
    if _spent:
        _spent[-1].append(path)
    return spark.read.schema(result.schema).parquet(path)


def with_group_values(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the values of its group; null keys are a group of their own.

    ``groups`` has a row per key. Up to ``BROADCAST_ROWS`` groups are broadcast, after they
    have been counted; more are joined by key, where Spark splits the rows of a hot key.
    """
    names = {k: f"{OWN}of_{k}" for k in keys}
    groups = written(groups, "groups").withColumnsRenamed(names)
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(groups[names[k]]) for k in keys])
    return df.join(groups, match, "left").drop(*names.values())


def text_key() -> Column:
    """With doc_id, what tells documents apart: rows alike in both are decided alike."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def decided(docs: DataFrame, keys: DataFrame, how: str, key: Column) -> DataFrame:
    """Documents that are (``left_semi``) or are not (``left_anti``) among ``keys``.

    ``keys`` has doc_id and, second, the value of ``key`` for a document; null ids are equal.
    """
    keys = keys.toDF(f"{OWN}id", f"{OWN}of").distinct()
    match = docs["doc_id"].eqNullSafe(F.col(f"{OWN}id")) & (F.col(f"{OWN}key") == F.col(f"{OWN}of"))
    return docs.withColumn(f"{OWN}key", key).join(keys, match, how).drop(f"{OWN}key")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(-1))
