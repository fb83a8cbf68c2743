import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column function over a list of inputs, in order."""

    def run(function, rows, schema):
        from pyspark.sql import functions as F

        names = [field.split()[0] for field in schema.split(", ")]
        df = spark.createDataFrame(
            [(i, *row) for i, row in enumerate(rows)], f"_i int, {schema}"
        )
        out = df.select("_i", function(*[F.col(n) for n in names]).alias("out")).collect()
        return [r["out"] for r in sorted(out, key=lambda r: r["_i"])]

    return run
