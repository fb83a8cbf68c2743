"""License notices in texts by an exact set-similarity join of text blocks and templates.

A block is a run of words of the whole text, whatever lines they are on. Templates are in classes by
their number of words, up to 8, 16, 32 and so on; blocks of a class are twice as long and
begin every so many words, so every run of a template's words lies within one. A template matches a
block that holds at least ``CONTAINMENT`` of its distinct words. Tokens are ordered by how many blocks of
the whole corpus hold them, rarest first (blocks with fewer template words than the smallest
template of their class needs are out before). With ``need`` words of a template required,
every matching block holds one of the first ``size - need + 1`` words of that order (prefix filter):
those words alone are join keys. A block with fewer template words than needed cannot match (length
filter), nor one whose words that rank from the joined word on are too few (positional filter).
What is left is counted exactly.

Templates are a list in the code; their words, some hundred, are broadcast, with their counts. A text is
read once; what is written of it are places of phrases and the template words of its blocks, and
one row per document comes back. All of it is DataFrame functions.

Defined results: a null text is empty: no words, no labels, nulls for first and last word, score
0; rows alike in doc_id and text are labelled alike; null ids are kept; other columns are not
read. The score is the highest containment of a template, 1 where a phrase stands.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import WORD_PATTERN, lowered, table, text_key, written

CONTAINMENT = 0.9
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Usual notices of public licenses and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this"
     " software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of"
     " the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are"
     " permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or"
     " without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial license",
     "cc-by-nc"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("shared under cc by nc 4 0", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
]


def normalised(text: Column) -> Column:
    """Lower-case words with one blank around each; a single blank if there is no word."""
    spaced = F.regexp_replace(lowered(text), BETWEEN, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def n_words(words: Column) -> Column:
    blanks = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(F.length(words) <= 2, F.lit(0)).otherwise(blanks - 1).cast("long")


def phrase_places(words: Column, phrase: str) -> Column:
    """Word numbers where a phrase stands, from 0; the text is split only if it holds it."""
    parts = F.split(words, f"(?<= ){phrase}(?= )")
    length = phrase.count(" ") + 1

    def blanks(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))

    # A part begins and ends with a blank, so its words are its blanks less one; between two
    # adjacent phrases stands one blank and no word.
    numbers = F.transform(parts, lambda p, i: blanks(p) - 1)
    before = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.aggregate(F.slice(numbers, 1, i), F.lit(0), lambda n, x: n + x)
        + (i - 1) * length,
    )
    none = F.array().cast("array<int>")
    return F.when(F.contains(words, F.lit(f" {phrase} ")), before).otherwise(none)


def templates(spark: SparkSession, listed: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = [
        (i, label, span(len(text.split())), sorted(set(text.split())))
        for i, (text, label) in enumerate(listed)
    ]
    return spark.createDataFrame(rows, "template int, label string, span int, words array<string>")


def needed(size: Column) -> Column:
    """Words that a block must hold of a template of ``size`` distinct words."""
    return F.ceil(size * CONTAINMENT - 1e-9).cast("int")


def span(n_words: int) -> int:
    """The class of a template: how many words apart its blocks begin."""
    return 1 << max((n_words - 1).bit_length(), 3)


def blocks_of(words: Column, n: Column, listed: list[tuple[str, str]]) -> Column:
    """Blocks (span, block, found) of a text's ``n`` words that hold enough words of templates."""
    classes: dict[int, list[set[str]]] = {}
    for text, _ in listed:
        classes.setdefault(span(len(text.split())), []).append(set(text.split()))
    return F.concat(*[_blocks_of_class(words, n, size, sets) for size, sets in sorted(classes.items())])


def _blocks_of_class(words: Column, n: Column, size: int, sets: list[set[str]]) -> Column:
    known = F.array(*[F.lit(w) for w in sorted(set().union(*sets))])
    least = min(math.ceil(len(s) * CONTAINMENT - 1e-9) for s in sets)

    def block(i: Column) -> Column:
        found = F.array_intersect(F.slice(words, i * size + 1, 2 * size), known)
        return F.struct(F.lit(size).alias("span"), i.cast("int").alias("block"), found.alias("found"))

    # A block that begins behind the last but one start holds no more than the one before.
    last = F.greatest(F.ceil(n / size).cast("int") - 2, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), block)
    return F.filter(blocks, lambda b: F.size(b["found"]) >= least)


def similarity_join(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, _key, span, block, template, label, containment) of every match.

    ``blocks`` is read twice: for the frequencies of tokens and for the join.
    """
    counts = blocks.select(F.explode("found").alias("word")).groupBy("word").count()
    wanted = listed.select("template", "label", "span", F.explode("words").alias("word"))
    ranked = (
        wanted.select("word").distinct().join(counts, "word", "left")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)), "word"))).alias("o"))
        .select(F.posexplode("o").alias("rank", "o"))
        .select(F.col("o.word").alias("word"), "rank")
    )
    prefixes = (
        wanted.join(F.broadcast(ranked), "word")
        .groupBy("template", "label", "span")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"].alias("words"))
        .withColumns({"size": F.size("words"), "need": needed(F.size("words"))})
        .withColumn("_prefix", F.slice("words", 1, F.col("size") - F.col("need") + 1))
        .select("template", "label", "span", "words", "need", "size",
                F.posexplode("_prefix").alias("place", "word"))
    )
    held = blocks.select("*", F.explode("found").alias("word"))
    candidates = held.join(F.broadcast(prefixes), ["span", "word"]).filter(
        # Length filter, and positional filter: the words from the joined one on must do.
        (F.size("found") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("found", "words"))
    first = F.array_position(F.transform("words", lambda w: F.array_contains("found", w)), True) - 1
    return (
        candidates.filter(F.col("place") == first)
        .withColumn("_overlap", overlap)
        .filter(F.col("_overlap") >= F.col("need"))
        .select("doc_id", "_key", "span", "block", "template", "label",
                (F.col("_overlap") / F.col("size")).alias("containment"))
    )


def license_labels(docs: DataFrame, listed: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: word count, places of phrases, labels of blocks and their score."""
    rows = templates(docs.sparkSession, listed)
    words = normalised(F.coalesce("text", F.lit("")))
    split = docs.select("doc_id", text_key().alias("_key"), words.alias("_words")).withColumns(
        {"n_words": n_words(F.col("_words")), "_list": F.split(F.trim("_words"), " ")}
    )
    base = written(
        split.select(
            "doc_id", "_key", "n_words",
            *[phrase_places(F.col("_words"), p).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)],
            blocks_of(F.col("_list"), F.col("n_words"), listed).alias("_blocks"),
        ),
        "blocks",
    )
    blocks = base.select("doc_id", "_key", F.inline("_blocks"))
    labelled = similarity_join(blocks, rows).groupBy("doc_id", "_key").agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"),
    ).withColumnsRenamed({"doc_id": "_id", "_key": "_of"})
    places = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    base_labels = F.array_compact(F.array(
        *[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]
    ))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))
    every = F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return (
        base.withColumns({"_places": places, "_base": base_labels})
        .join(labelled, match, "left")
        .select(
            "doc_id", "n_words",
            F.size("_places").cast("long").alias("n_base"),
            F.array_min("_places").cast("long").alias("first_word"),
            F.array_max("_places").cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
            F.when(F.size("_places") > 0, F.lit(1.0))
            .otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
        )
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Containment counted for every block and template, without filters."""
    listed = ", ".join(
        f"({i}, '{label}', {span(len(t.split()))}, {sorted(set(t.split()))})"
        for i, (t, label) in enumerate(TEMPLATES)
    )
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES)
    longest = max(p.count(" ") + 1 for p, _ in PHRASES)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    split = f"regexp_extract_all(translate({{}}, '{upper}', '{lower}'), '{WORD_PATTERN}')"
    return f"""
WITH templates(template, label, span, words) AS (VALUES {listed}),
phrases(label, words) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT r, doc_id, {split.format('text')} AS w FROM docs),
words AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM texts),
runs AS (
  SELECT r, p, [word, {", ".join(f"lead(word, {i}) OVER o" for i in range(1, longest))}] AS run
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)
),
places AS (
  SELECT r, label, p AS place FROM runs JOIN phrases ON run[1] = words[1] AND run[:len(words)] = words
),
base AS (
  SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word,
    list(DISTINCT label) AS labels
  FROM places GROUP BY r
),
wanted AS (SELECT template, label, span, len(words) AS size, unnest(words) AS word FROM templates),
held AS (
  SELECT r, n, template, label, span, size, word, unnest([p // span, p // span - 1]) AS block
  FROM words JOIN wanted USING (word)
),
found AS (
  SELECT r, label, count(DISTINCT word) / any_value(size) AS part
  FROM held WHERE block >= 0 AND block < greatest(ceil(n / span) - 1, 1)
  GROUP BY r, template, label, block
  HAVING count(DISTINCT word) >= ceil(any_value(size) * {CONTAINMENT} - 1e-9)
),
matched AS (SELECT r, list(DISTINCT label) AS labels, max(part) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(m.labels, []))), ',')
    AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN base b USING (r) LEFT JOIN matched m USING (r)
"""


QUERIES = {"op9_licenses": op9_licenses}
CHECKS = {"op9_licenses": _sql()}
