"""Groups that are complete after a while: chats, attempts of a prompt, and the like.

Rows of a group arrive in any order, some twice, some late. A group is open until the watermark (the
latest time seen, less a delay) has passed its last row by ``idle``; then it is finished once, by the
same function that reads closed tables. Rows that arrive for a group after that are kept apart.

Open rows and the clock are the state; rows of groups that a batch finishes are in the table it wrote
before, and are left out when that is read again. A micro-batch reads the state of the one before it and writes
its own, the finished groups and the late rows under its number, so a batch that is run again after a
failure writes the same again, and a restarted stream goes on where it was. The state holds open
groups only; the numbers of finished groups are kept for as long as late rows are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Groups:
    """A stream of groups, whose results and state are in ``folder``.

    ``key`` names a group, ``order`` a row within it, ``time`` a timestamp. ``finish`` gives the results
    of complete groups. ``delay`` and ``idle`` are seconds; groups finished more than ``remembered``
    seconds before the watermark are forgotten, and rows for them open a new group.
    """

    def __init__(
        self, folder: str, key: str, order: str, time: str, finish: Callable[[DataFrame], DataFrame],
        delay: int = 600, idle: int = 1800, remembered: int = 86_400,
    ):
        self.folder, self.key, self.order, self.time = folder.rstrip("/"), key, order, time
        self.finish, self.delay, self.idle, self.remembered = finish, delay, idle, remembered

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Read what there is, in micro-batches, and stop."""
        return (
            stream.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/finished/*")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late/*")

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. Every table is written once and read from there by the next step."""
        spark = batch.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.folder}/{name}/{number:012d}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        def before(name: str, schema: DataFrame) -> DataFrame:
            if number == 0:
                return schema.limit(0)
            return spark.read.schema(schema.schema).parquet(f"{self.folder}/{name}/{number - 1:012d}")

        seconds = F.col(self.time).cast("double")
        clock = batch.agg(F.max(seconds).alias("latest"))
        clock = kept(clock.unionByName(before("clock", clock)).agg(F.max("latest").alias("latest")), "clock")
        latest = clock.first()["latest"]
        passed = F.lit(None if latest is None else latest - self.delay).cast("double")
        done = before("done", batch.select(F.col(self.key).alias("_done"), F.lit(0.0).alias("_at")))
        known = F.col(self.key).eqNullSafe(F.col("_done"))
        kept(batch.join(done, known, "left_semi"), "late")
        fresh = batch.join(done, known, "left_anti")
        # By ranges, so that a group's rows stay together and a large group is in many tasks.
        ranged = self._still_open(before("open", batch), before("closing", done)).unionByName(fresh)
        ranged = ranged.repartitionByRange(self.key, self.order)
        rows = kept(ranged.dropDuplicates([self.key, self.order]), "open")
        ends = rows.groupBy(self.key).agg(F.max(seconds).alias("_last"))
        closed = ends.filter(F.col("_last") + self.idle < passed).withColumnsRenamed({self.key: "_done"})
        # Written before rows are told apart by it, with what is remembered of earlier batches.
        closing = kept(closed.select("_done", F.col("_last").alias("_at")), "closing")
        kept(self.finish(rows.join(closing, known, "left_semi")), "finished")
        recent = done.unionByName(closing).filter(F.col("_at") + self.idle + self.remembered >= passed)
        kept(recent, "done")
        self._forget(spark, number - 2)

    def flush(self, spark: SparkSession) -> DataFrame:
        """Results of the groups that are still open, for when nothing more will come."""
        last = self._last(spark)
        rows, closing = (spark.read.parquet(f"{self.folder}/{name}/{last}") for name in ("open", "closing"))
        return self.finish(self._still_open(rows, closing))

    def _still_open(self, rows: DataFrame, closing: DataFrame) -> DataFrame:
        """Rows of a state without those of the groups that its batch has finished."""
        return rows.join(closing, F.col(self.key).eqNullSafe(F.col("_done")), "left_anti")

    def _forget(self, spark: SparkSession, number: int) -> None:
        """Delete a state that no batch can ask for again."""
        for name in ("clock", "open", "closing", "done"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{number:012d}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _last(self, spark: SparkSession) -> str:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/open")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        return max(f.getPath().getName() for f in files)
