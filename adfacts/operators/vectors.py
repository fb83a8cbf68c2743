"""Seniority by word vectors: every word of an ad votes for the labels it is close to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions.text import joined_text, strip_tags
from adfacts.functions.tokens import tokens
from adfacts.functions.values import once
from adfacts.operators.grouping import group_join
from adfacts.session import pinned


def label_vectors(word_vectors: DataFrame, labels: list[str] = K.VOTE_LABELS) -> DataFrame:
    """Mean vector of the words of each label; a label without any known word is left out."""
    spark = word_vectors.sparkSession
    words = sorted({word for label in labels for word in label.split()})
    label_words = spark.createDataFrame(
        [(i, label, word) for i, label in enumerate(labels) for word in label.split()],
        "label_order int, label string, word string",
    )
    places = (
        word_vectors.filter(F.col("word").isin(words))
        .select("word", F.posexplode("vector").alias("place", "x"))
        .join(F.broadcast(label_words), "word")
    )
    return (
        places.groupBy("label_order", "label", "place")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label_order", "label")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("places"))
        .select("label_order", "label", F.col("places.x").alias("vector"))
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def _known(labels: DataFrame) -> Column:
    """Places of the labels that have a vector, as one array."""
    return labels.agg(F.collect_set("label_order")).scalar()


def word_votes(
    word_vectors: DataFrame, labels: DataFrame, n_labels: int, threshold: float = 0.5
) -> DataFrame:
    """Per word its cosine to every label, 0 unless above the threshold.

    ``votes`` has a place for each of the ``n_labels`` labels in list order, 0 for one without
    a vector. Words close to no label are left out. The label vectors are a short list by nature
    and come in as one array, so this is a projection of the vocabulary.
    """
    places = word_vectors.sparkSession.range(n_labels).select(F.col("id").cast("int").alias("label_order"))
    listed = (
        places.join(labels, "label_order", "left")
        .select(F.struct("label_order", "vector", _norm(F.col("vector")).alias("norm")).alias("l"))
        .agg(F.sort_array(F.collect_list("l")))
    )

    def vote(label: Column) -> Column:
        cosine = _dot(F.col("vector"), label["vector"]) / (F.col("_norm") * label["norm"])
        return once(cosine, lambda c: F.when(c > threshold, c).otherwise(F.lit(0.0)))

    # Filtered inside the generator: a filter on the finished column would be pushed below it
    # and compute every cosine again.
    voting = F.filter(
        F.array(F.transform("_labels", vote)), lambda votes: F.exists(votes, lambda v: v > 0)
    )
    return (
        word_vectors.withColumns({"_norm": _norm(F.col("vector")), "_labels": listed.scalar()})
        .filter(F.col("_norm") > 0)
        .select("word", F.explode(voting).alias("votes"))
    )


def ad_words(ads: DataFrame, key: str, *parts: str) -> DataFrame:
    """The words of each ad, one row each; an ad without words keeps one empty row."""
    text = F.lower(strip_tags(joined_text(*[F.col(p) for p in parts])))
    return ads.select(key, F.explode_outer(tokens(text)).alias("word"))


# Voting words that are sent to all tasks; a row is a word and a vote per label.
SENT_WORDS = 100_000


def label_scores(
    words: DataFrame, key: str, votes: DataFrame, labels: DataFrame, n_labels: int
) -> DataFrame:
    """Per ad the sum of its words' votes, one place of ``scores`` per label in list order.

    The place of a label without a vector is null. Only words that vote leave a row; an ad without
    any is there by its key. Voting words are counted and then sent to all tasks if there are up to
    ``SENT_WORDS``; more of them are joined by word.
    """
    votes = pinned(votes)
    if votes.count() <= SENT_WORDS:
        votes = F.broadcast(votes)
    known = _known(labels)
    names = [f"_{i}" for i in range(n_labels)]
    voted = group_join(words, votes, ["word"]).select(
        key, *[F.get("votes", F.lit(i)).alias(name) for i, name in enumerate(names)]
    )
    every = voted.unionByName(words.select(key).distinct(), allowMissingColumns=True)
    scores = F.array(
        *[
            F.when(F.array_contains(known, F.lit(i)), F.coalesce(F.col(f"_{i}"), F.lit(0.0)))
            for i in range(n_labels)
        ]
    )
    sums = every.groupBy(key).agg(*[F.sum(name).alias(name) for name in names])
    return sums.select(key, scores.alias("scores"))


def shares(scores: Column) -> Column:
    """Scores divided by their total; all 0 if the total is 0; a null stays null."""
    total = F.aggregate(scores, F.lit(0.0), lambda t, s: t + F.coalesce(s, F.lit(0.0)))
    return once(
        total,
        lambda t: F.transform(
            scores, lambda s: F.when(t > 0, s / t).when(s.isNotNull(), F.lit(0.0))
        ),
    )


def winner(scores: Column, labels: list[str]) -> Column:
    """The label with the top share; the first in list order among equals.

    A label without a vector (a null) never wins; null if no label has one.
    """
    listed = F.array(*[F.lit(label) for label in labels])
    place = once(scores, lambda s: F.array_position(s, F.array_max(s)) - 1)
    return F.get(listed, place.cast("int"))


def by_label(df: DataFrame, key: str, values: str, labels: list[str], name: str) -> DataFrame:
    """One row per ad and label that has a vector, from an array with a place per label."""
    listed = F.array(*[F.lit(label) for label in labels])
    zipped = F.arrays_zip(listed.alias("label"), F.col(values).alias(name))
    rows = df.select(key, F.inline(zipped)).toDF(key, "label", name)
    return rows.filter(F.col(name).isNotNull())
