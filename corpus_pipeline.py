"""From raw documents to a training mix: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adfacts.llm.common import table, written
from adfacts.llm.contamination import without_contaminated
from adfacts.llm.mixing import mixed
from adfacts.llm.near_copies import one_of_each
from adfacts.llm.quality import accepted
from adfacts.llm.secret_scan import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic documents go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every document stays."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources have tempered weights, in shuffled order."""
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("contamination", contamination),
    ("secrets", secrets),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier is fitted and copies are found by sketches: no SQL says the same.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
CHECKS: dict[str, str] = {}
