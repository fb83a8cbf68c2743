"""Language of texts by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of letters, most frequent first; words
are set apart by a blank. A text is of the language whose profile its own is least out of place
to: per n-gram of the text the difference of the ranks, ``PROFILE`` if the language has it not.

Counting is numpy on whole batches inside tasks; partial counts per language, whose number is
that of different n-grams, are summed by a shuffle. The model is ``PROFILE`` rows per language.
Documents are read and never moved.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing was learned; equal counts rank by n-gram, equal distances by language; repeated
rows are predicted each; a null id is never held out; ids and sources are no input. The score is
how much nearer the chosen language is than the next: 0 for none, towards 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adfacts.llm.common import fold, table

PROFILE = 300
# Letters, with the marks on them; numerals of any kind are none.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
BITS = 21
PIECE = 1 << 20


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-case words with a blank around each."""
    found = LETTERS.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.int64)
    joined = " " + " ".join(found) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def grams(points: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as numbers; those of a blank alone or with a blank inside are left out."""
    blank = points == 32
    two = (points[:-1] << BITS) | points[1:]
    three = (two[:-1] << BITS) | points[2:]
    return np.concatenate(
        [points[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]]
    )


def pieces(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and counts of one piece after the other, to be summed.

    Pieces share two points, so that no n-gram is cut; what two of them hold is taken off.
    """
    for start in range(0, len(points), PIECE):
        yield np.unique(grams(points[start:start + PIECE + 2]), return_counts=True)
        shared = grams(points[start + PIECE:start + PIECE + 2])
        if len(shared):
            yield shared, np.full(len(shared), -1)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts."""
    if len(points) <= PIECE:
        return np.unique(grams(points), return_counts=True)
    kinds, numbers = (np.concatenate(parts) for parts in zip(*pieces(points)))
    kinds, places = np.unique(kinds, return_inverse=True)
    numbers = np.bincount(places, numbers).astype(np.int64)
    return kinds[numbers > 0], numbers[numbers > 0]


def ranked(kinds: np.ndarray, numbers: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram."""
    if len(kinds) > size:
        # Only what reaches the count of the last place takes part in the sort.
        least = np.partition(numbers, len(numbers) - size)[len(numbers) - size]
        kept = numbers >= least
        kinds, numbers = kinds[kept], numbers[kept]
    return kinds[np.lexsort((kinds, -numbers))][:size]


def learned(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profile of every language of ``docs`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                by_lang.setdefault(lang.as_py(), []).append(letters_of(text.as_py()))
            for lang, parts in by_lang.items():
                # Every text begins and ends with a blank, so no n-gram spans two texts.
                for kinds, numbers in pieces(np.concatenate(parts)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(numbers)],
                        names=["lang", "gram", "n"],
                    )

    counts = (
        docs.select("text", "lang")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(order) - 1)
        .filter(F.col("rank") < size)
        .select("lang", "gram", "rank")
    )


class Profiles:
    """Profiles of all languages as one sorted list of n-grams with a row of ranks each."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        places = {g: i for i, g in enumerate(self.grams.tolist())}
        for lang, gram, rank in rows:
            self.ranks[places[gram], self.langs.index(lang)] = rank

    def distances(self, points: np.ndarray) -> tuple[np.ndarray, int]:
        """Out-of-place distance to each language, and the largest it could be."""
        own = ranked(*counted(points), self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = -1
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, away).sum(0), len(own) * self.size

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters_of(text)
        if not len(points) or not self.langs:
            return UNKNOWN, 0.0
        away, most = self.distances(points)
        best = int(np.argmin(away))
        second = min([int(d) for i, d in enumerate(away) if i != best], default=most)
        return self.langs[best], (second - int(away[best])) / second if second else 0.0


def with_language(docs: DataFrame, profiles: DataFrame, *columns: str) -> DataFrame:
    """The named columns with ``lang_pred`` and ``score``. Profiles are few rows per language."""
    rows = [tuple(r) for r in profiles.select("lang", "gram", "rank").collect()]
    model = docs.sparkSession.sparkContext.broadcast(Profiles(rows))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns],
                 pa.array([lang for lang, _ in found], pa.string()),
                 pa.array([score for _, score in found], pa.float64())],
                names=[*columns, "lang_pred", "score"],
            )

    read = docs.select(*columns, F.col("text").alias("_text"))
    return read.mapInArrow(predict, f"{schema}, lang_pred string, score double")


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    profiles = learned(docs.filter(~F.col("held_out") & F.col("lang").isNotNull()))
    return with_language(docs, profiles, "doc_id", "held_out").select(
        "doc_id", "held_out", "lang_pred", "score"
    )


QUERIES = {"op8_languages": op8_languages}
CHECKS: dict[str, str] = {}
