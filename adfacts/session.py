"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


FEW_SPLITS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session may go without ``spark.checkpoint.dir``; it gets a new temporary
    folder, which is deleted with the process.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="adfacts-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses.

    All of an application's are in one folder, which is deleted when the application ends.
    """
    context = spark.sparkContext
    own = f"{shared_folder(spark).rstrip('/')}/adfacts/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    Used where a value differs between two runs of the same plan (the slice a row
    falls into, the answer a model gives) and both readers must see the same one.
    """
    path = new_folder(df.sparkSession, "pinned")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of long arrays that a Python worker gets at once.
BATCH_SIZE, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get at most ``BATCH`` rows at a time from what is run inside."""
    before = spark.conf.get(BATCH_SIZE)
    spark.conf.set(BATCH_SIZE, min(int(before), BATCH) if int(before) > 0 else BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SIZE, before)


def spread_out(df: DataFrame) -> DataFrame:
    """A source over all cores, for much work per row on fewer splits than cores.

    An array of records is read by one task per file. A source with enough splits is returned
    as it is, and so is one of ``FEW_SPLITS`` or more, however many cores there are: moving that
    much text costs more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df
