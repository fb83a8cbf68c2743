"""A stream of groups against the same rows as a closed table."""

import random

from pyspark.sql import functions as F

from adfacts.operators.transcripts import final_answers
from adfacts.operators.verify import checked, first_valid
from adfacts.plans.ordered import streamed_first_valid
from adfacts.operators.verify import checked, first_valid
from adfacts.streaming.groups import Groups

CHAT = "conv_id long, idx long, name string, content string, at timestamp"


def chats(spark, n):
    rng = random.Random(8)
    rows = []
    for c in range(n):
        agent = rng.choice(["Salary", "Seniority", "Arrangement"])
        for i in range(rng.randrange(1, 9)):
            name = "User" if i == 0 else rng.choice([agent, "Critic", "Salary"])
            content = f"[TASK: {agent}] ad" if i == 0 else rng.choice(["TERMINATE", "again", f" answer {c} {i} "])
            rows.append((c, i, name, content, 1_000_000 + c * 100 + i))
    df = spark.createDataFrame(rows, "conv_id long, idx long, name string, content string, s long")
    return df.withColumn("at", F.timestamp_seconds("s")).drop("s")


def put(rows, folder, number):
    rows.coalesce(1).write.parquet(f"{folder}/in/{number}")


def run(spark, groups, folder):
    stream = spark.readStream.schema(CHAT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    groups.start(stream).awaitTermination()


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chats_like_a_closed_table_after_shuffling_repeats_and_restarts(spark, tmp_path):
    every = chats(spark, 60).cache()
    folder = str(tmp_path)
    part = F.pmod(F.xxhash64("conv_id", "idx"), F.lit(4))
    groups = Groups(f"{folder}/out", "conv_id", "idx", "at", final_answers, delay=10**6, idle=50)
    for i in (2, 0, 2):  # one file comes twice
        put(every.filter(part == i), folder, len(list((tmp_path / "in").glob("*"))) if (tmp_path / "in").exists() else 0)
    run(spark, groups, folder)
    for i in (3, 1, 0):
        put(every.filter(part == i), folder, 10 + i)
    # Another process goes on where the first one was.
    again = Groups(f"{folder}/out", "conv_id", "idx", "at", final_answers, delay=10**6, idle=50)
    run(spark, again, folder)
    run(spark, again, folder)
    assert shown(again.results(spark).unionByName(again.flush(spark))) == shown(final_answers(every))
    assert again.late(spark).count() == 0


def test_groups_are_finished_once_the_watermark_has_passed(spark, tmp_path):
    every = chats(spark, 50).cache()
    folder = str(tmp_path)
    groups = Groups(f"{folder}/out", "conv_id", "idx", "at", final_answers, delay=300, idle=50)
    for i in range(5):
        put(every.filter(F.floor(F.col("conv_id") / 10) == i), folder, i)
    run(spark, groups, folder)
    done = groups.results(spark)
    finished = {r["conv_id"] for r in done.collect()}
    assert finished == set(range(46)) and done.count() == 46
    assert shown(done.unionByName(groups.flush(spark))) == shown(final_answers(every))
    # Rows for a finished chat are apart; those for an open one are not.
    late = every.filter("conv_id in (3, 48)").withColumn("idx", F.lit(99).cast("long"))
    put(late, folder, 9)
    run(spark, groups, folder)
    assert {r["conv_id"] for r in groups.late(spark).collect()} == {3}
    assert groups.results(spark).count() == 46


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    every = chats(spark, 30).cache()
    groups = Groups(str(tmp_path / "out"), "conv_id", "idx", "at", final_answers, delay=0, idle=10)
    for number in (0, 1, 1, 2, 2):
        groups.take(every.filter(F.pmod("conv_id", F.lit(3)) == number), number)
    assert shown(groups.results(spark).unionByName(groups.flush(spark)))[:3]
    ids = [r["conv_id"] for r in groups.results(spark).collect()]
    assert len(ids) == len(set(ids))


def test_attempts_like_a_closed_table(spark, tmp_path):
    rng = random.Random(9)
    raws = ["Output: 100-900-AUD-MONTHLY", "900-100-AUD-MONTHLY", None, "x"]
    rows = [(p, a, "Salary", rng.choice(raws)) for p in range(80) for a in range(1, rng.randrange(2, 7))]
    df = spark.createDataFrame(rows, "prompt_id long, attempt int, task_type string, raw string")
    df = df.withColumn("at", F.timestamp_seconds(F.lit(1_000_000) + F.col("prompt_id") * 60)).cache()

    def finish(found):
        return first_valid(checked(found))

    groups = Groups(str(tmp_path / "out"), "prompt_id", "attempt", "at", finish, delay=10**6)
    for i in range(3):
        df.filter(F.pmod(F.xxhash64("prompt_id", "attempt"), F.lit(3)) == i).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    groups.start(stream).awaitTermination()
    assert shown(groups.results(spark).unionByName(groups.flush(spark))) == shown(finish(df))


def test_streamed_queries_are_whole_over_many_files_and_a_long_time(spark):
    # More files than one batch once took, and more time than the delay that was fixed.
    attempts = spark.range(240).repartition(6).select(
        (F.floor(F.col("id") / 4) * 20_000).alias("prompt_id"), (F.col("id") % 4 + 1).alias("attempt"),
        F.lit("Seniority").alias("task_type"),
        F.when(F.col("id") % 4 > F.floor(F.col("id") / 4) % 5, "Output: Senior").otherwise("x").alias("raw"),
    )
    want = first_valid(checked(attempts)).select("prompt_id", "answer", "accepted", "re_attempts")
    assert sorted(map(str, streamed_first_valid(attempts).collect())) == sorted(map(str, want.collect()))
