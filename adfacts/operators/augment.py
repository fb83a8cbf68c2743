"""More rows for rare classes and rewritten headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts.functions import text as T
from adfacts.functions.values import once
from adfacts.operators.grouping import group_join
from adfacts.session import pinned

VARIANTS = ["de", "fr"]
# Words, and what stands between them.
PIECES = r"[\p{L}]+|[^\p{L}]+"
# Words of a synonym table that is sent to all tasks.
SENT_SYNONYMS = 100_000


def _unchanged(c: Column, variant: Column) -> Column:
    return c


def _picked(values: list[str], key: Column) -> Column:
    listed = F.array(*[F.lit(v) for v in values])
    return F.get(listed, F.pmod(key, F.lit(len(values))).cast("int"))


def header_variants(
    ads: DataFrame,
    employers: list[str],
    towns: list[str],
    key: str = "ad_id",
    reword: Callable[[Column, Column], Column] = _unchanged,
) -> DataFrame:
    """The ads plus two rewritten copies of each; tail and label stay.

    The employer is always set, the location only where one is given. Names are picked from
    the lists by the key. ``reword(text, variant)`` paraphrases title, abstract and highlights.
    """
    variants = F.array(*[F.lit(v) for v in VARIANTS])
    copies = ads.select("*", F.posexplode(variants).alias("_n", "variant"))
    copies = copies.withColumn("_h", T.split_header(F.col("prompt")))
    pick = F.col(key) * len(VARIANTS) + F.col("_n")
    place = F.col("_h.location")
    header = F.struct(
        reword(F.col("_h.job_title"), F.col("variant")).alias("job_title"),
        reword(F.col("_h.abstract"), F.col("variant")).alias("abstract"),
        _picked(employers, pick).alias("employer"),
        F.when((place != "") & (place != "-"), _picked(towns, pick))
        .otherwise(place)
        .alias("location"),
        reword(F.col("_h.highlights"), F.col("variant")).alias("highlights"),
        F.col("_h.tail").alias("tail"),
    )
    copies = copies.withColumn("prompt", T.build_header(header)).drop("_n", "_h")
    return ads.withColumn("variant", F.lit("original")).unionByName(copies)


def top_up(
    df: DataFrame,
    n: int = 5,
    label: str = "complete",
    key: str = "row_id",
    change: Callable[[Column], Column] | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Copies for every class with fewer than ``n`` rows, so that each has ``n``.

    Members are taken in turn, by key or by a seeded hash of it. Classes are counted on the
    label alone; only the rows of rare ones, fewer than ``n`` each, are then numbered.
    """
    turn = [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    rare = sizes.filter(F.col("_size") < n)
    members = group_join(df, rare, [label]).withColumn(
        "_turn", F.row_number().over(Window.partitionBy(label).orderBy(*turn))
    )
    copy_numbers = F.filter(
        F.sequence(F.lit(1), F.lit(n) - F.col("_size").cast("int")),
        lambda k: F.pmod(k - 1, F.col("_size")) + 1 == F.col("_turn"),
    )
    copies = members.select(*df.columns, F.explode(copy_numbers).alias("copy"))
    if change is not None:
        copies = copies.withColumn("prompt", change(F.col("prompt")))
    return df.withColumn("copy", F.lit(0)).unionByName(copies)


def one_synonym(text: Column, synonyms: dict[str, str]) -> Column:
    """The text with its first word that has a synonym replaced, at most one."""
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    pieces = F.regexp_extract_all(T.text_or_empty(text), F.lit(PIECES), F.lit(0))

    def swapped(words: Column) -> Column:
        hits = F.transform(words, lambda w: F.lower(w).isin(list(synonyms)))
        return once(F.array_position(hits, True), lambda first: _replaced(words, first, known))

    return F.array_join(once(pieces, swapped), "")


def first_synonyms(
    df: DataFrame, synonyms: DataFrame, key: str, text: str = "prompt"
) -> DataFrame:
    """``one_synonym`` by a table (word, synonym) of any size; ``key`` is unique.

    Only words with a synonym leave a row of the texts: the table is counted and sent to all tasks
    if it has up to ``SENT_SYNONYMS`` words, and joined by word if it has more. The first of a
    text's hits comes back by its key. Of several synonyms of a word the first by spelling is taken.
    """
    listed = pinned(
        synonyms.groupBy(F.lower("word").alias("_word")).agg(F.min("synonym").alias("_synonym"))
    )
    if listed.count() <= SENT_SYNONYMS:
        listed = F.broadcast(listed)
    pieces = F.regexp_extract_all(T.text_or_empty(F.col(text)), F.lit(PIECES), F.lit(0))
    first = (
        df.select(F.col(key).alias("_key"), F.posexplode(pieces).alias("_place", "_piece"))
        .withColumn("_word", F.lower("_piece"))
        .join(listed, "_word")
        .groupBy("_key").agg(F.min(F.struct("_place", "_synonym")).alias("_first"))
    )
    swapped = F.transform(
        pieces,
        lambda w, i: F.when(i == F.col("_first._place"), F.col("_first._synonym")).otherwise(w),
    )
    whole = T.text_or_empty(F.col(text))
    return (
        df.join(first, F.col(key) == F.col("_key"), "left")
        .withColumn(text, F.when(F.col("_first").isNull(), whole).otherwise(F.array_join(swapped, "")))
        .drop("_key", "_first")
    )


def _replaced(words: Column, place: Column, known: Column) -> Column:
    return F.transform(
        words,
        lambda w, i: F.when(i + 1 == place, F.try_element_at(known, F.lower(w))).otherwise(w),
    )


def label_counts(df: DataFrame, label: str = "complete") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def label_drift(train: DataFrame, test: DataFrame, label: str = "complete") -> DataFrame:
    """Labels that only one of the two sets has."""
    a, b = (df.select(F.col(label).alias("label")) for df in (train, test))
    sided = a.withColumns({"in_train": F.lit(1), "in_test": F.lit(0)}).unionAll(
        b.withColumns({"in_train": F.lit(0), "in_test": F.lit(1)})
    )
    return (
        sided.groupBy("label")
        .agg(F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test"))
        .filter(F.col("in_train") != F.col("in_test"))
        .select("label", F.when(F.col("in_train") == 1, "train").otherwise("test").alias("only_in"))
    )
