"""Ads, prompt records and result files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from adfacts.sources.records import csv_records, parsed

# Bytes of a file that holds one array.
LARGEST_ARRAY = 1 << 30


def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


SALARY_ADS = _texts(
    "job_title", "job_ad_details", "nation_short_desc", "salary_additional_text", "y_true"
)
SENIORITY_ADS = _texts(
    "job_title", "job_summary", "job_ad_details", "classification_name",
    "subclassification_name", "y_true",
)
ARRANGEMENT_ADS = _texts("job_ad", "y_true")
PAIRS = _texts("prompt", "complete")
RULE_RESULTS = _texts("y_true", "y_pred")
TASK_PAIRS = _texts("prompt", "complete", "task_type")
RESULTS = StructType(
    [
        StructField("row_id", LongType()),
        *_texts("prompt", "complete", "y_true", "y_pred", "y_predicted").fields,
        StructField("inference_time", DoubleType()),
    ]
)

# A quote inside a quoted field is doubled, fields may span lines and keep their spaces.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv(
    spark: SparkSession, path: str, schema: StructType, spans_lines: bool = True
) -> DataFrame:
    """The columns of ``schema`` from a CSV with a header; an empty field is null.

    Columns are taken by their name in the header; others are left out, an absent one is an
    error, and so is a file of a folder whose header differs. Files are read by split, also where
    fields span lines (see ``sources.records``); say ``spans_lines=False`` where no field does.
    """
    header = spark.read.options(**CSV, multiLine=spans_lines).csv(path).schema
    absent = [name for name in schema.names if name not in header.names]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    if spans_lines:
        rows = parsed(csv_records(spark, path), header, schema.names, CSV)
    else:
        reader = spark.read.options(**CSV).schema(header).option("enforceSchema", False)
        rows = reader.csv(path)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*columns).write.options(**CSV).csv(path)


def read_records(
    spark: SparkSession, path: str, schema: StructType, one_array: bool = False,
    largest: int = LARGEST_ARRAY,
) -> DataFrame:
    """JSON records, one per line, or (``one_array``) one array per file.

    A file that is one array is read by one task, so one of more than ``largest`` bytes is an error;
    such data had better be written as lines.
    """
    if one_array:
        files = spark.read.format("binaryFile").load(path).filter(F.col("length") > largest)
        for file in files.select("path", "length").limit(1).collect():
            raise ValueError(f"{file['path']} is an array of {file['length']} bytes, more than {largest}")
    return spark.read.schema(schema).json(path, multiLine=one_array)


def write_records(df: DataFrame, path: str, ascii_only: bool = False) -> None:
    """One JSON object per line in UTF-8; ``ascii_only`` escapes everything else."""
    df.write.option("writeNonAsciiCharacterAsCodePoint", ascii_only).json(path)


def read_results(spark: SparkSession, folder: str, one_array: bool = False) -> DataFrame:
    """All result files ``<model>.json`` (or folders of that name) with ``model`` added.

    Older files name the truth and the answer differently; both names end up in one column.
    """
    rows = read_records(spark, f"{folder}/*.json", RESULTS, one_array)
    model = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.json(?:/[^/]*)?$", 1)
    rows = rows.withColumn("model", F.url_decode(model))
    return rows.withColumns(
        {
            "complete": F.coalesce("complete", "y_true"),
            "y_pred": F.coalesce("y_pred", "y_predicted"),
        }
    ).drop("y_true", "y_predicted")

