"""The rules hold no state, so a stream of ads goes through the same projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from adfacts.operators.salary import salary_facts
from adfacts.sources.tables import CSV


def ad_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New CSV files of ads as they arrive in a folder."""
    return spark.readStream.schema(schema).options(**CSV).csv(folder, multiLine=True)


def write_salary_facts(ads: DataFrame, out: str, checkpoint: str):
    """Append the salary facts of every new ad once."""
    return (
        salary_facts(ads)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
