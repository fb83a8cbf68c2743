"""Cleaning and checking the text a model answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions.text import strip, text_or_empty
from adfacts.functions.values import once


def answer_text(raw: Column, mode: str = "direct") -> Column:
    """The part of a raw answer to read, null if there is none.

    ``direct`` takes the whole answer if it is longer than one character, ``chain`` what
    stands between the first and the second output marker.
    """
    if mode == "direct":
        return F.when(F.length(raw) > 1, strip(raw))
    if mode == "chain":
        return F.when(F.contains(raw, F.lit(K.OUTPUT_MARKER)), strip(F.get(F.split(raw, K.OUTPUT_MARKER), F.lit(1))))
    raise ValueError(f"unknown mode {mode!r}, expected 'direct' or 'chain'")


def clean_salary(raw: Column, mode: str = "direct") -> Column:
    return _found(F.regexp_extract(answer_text(raw, mode), K.ANSWER_SALARY, 1))


def _found(salary: Column) -> Column:
    return once(
        salary, lambda s: F.when(F.coalesce(s, F.lit("")) == "", F.lit(K.NO_SALARY)).otherwise(s)
    )


def clean_seniority(raw: Column, mode: str = "direct") -> Column:
    """The longest known label in the answer (list order among equals), else a near miss."""
    labels = K.SENIORITY_LABELS + (["unknown"] if mode == "chain" else [])
    entry = "entry level" if mode == "direct" else "entry-level"

    def label_in(text: Column) -> Column:
        chain = F
        for label in sorted(labels, key=len, reverse=True):
            chain = chain.when(F.contains(text, F.lit(label)), F.lit(label))
        level = F.contains(text, F.lit("level"))
        return (
            chain.when(level & F.contains(text, F.lit("entry")), F.lit(entry))
            .when(level & F.contains(text, F.lit("mid")), F.lit("mid-level"))
            .otherwise(F.lit("Unknown"))
        )

    return once(F.lower(answer_text(raw, mode)), label_in)


def clean_arrangement(raw: Column, mode: str = "direct", onsite_label: str = "OnSite") -> Column:
    found = F.regexp_extract(answer_text(raw, mode), "(?i)(onsite|hybrid|remote)", 1)
    return once(
        F.lower(found),
        lambda word: F.when(word == "onsite", F.lit(onsite_label))
        .when(word == "hybrid", F.lit("Hybrid"))
        .when(word == "remote", F.lit("Remote"))
        .otherwise(F.lit("Unknown")),
    )


def clean_answer(raw: Column, task: Column, mode: str = "direct") -> Column:
    """The cleaned answer for the task; an unknown task keeps the raw text."""
    return (
        F.when(task == "Salary", clean_salary(raw, mode))
        .when(task == "Seniority", clean_seniority(raw, mode))
        .when(task == "Work Arrangement", clean_arrangement(raw, mode))
        .otherwise(raw)
    )


def valid_salary(answer: Column) -> Column:
    whole = F.lit(r"^\+?\d+$")

    def good(parts: Column) -> Column:
        low, high = (strip(F.get(parts, F.lit(i))) for i in (0, 1))
        # Amounts of any length compare by digits: the longer is larger, equal lengths as text.
        a, b = (F.regexp_replace(n, r"^\+?0*", "") for n in (low, high))
        ordered = (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a <= b))
        return (
            (F.size(parts) == 4)
            & F.get(parts, F.lit(2)).isin(K.CURRENCIES)
            & F.get(parts, F.lit(3)).isin(K.FREQUENCIES)
            & F.rlike(low, whole)
            & F.rlike(high, whole)
            & ordered
        )

    return F.coalesce(once(F.split(strip(text_or_empty(answer)), "-"), good), F.lit(False))


def valid_seniority(answer: Column) -> Column:
    return F.coalesce(strip(answer).isin(K.SENIORITY_LABELS), F.lit(False))


def valid_arrangement(answer: Column, onsite_label: str = "OnSite") -> Column:
    return F.coalesce(strip(answer).isin(onsite_label, "Remote", "Hybrid"), F.lit(False))


def valid_answer(answer: Column, task: Column, onsite_label: str = "OnSite") -> Column:
    return (
        F.when(task == "Salary", valid_salary(answer))
        .when(task == "Seniority", valid_seniority(answer))
        .when(task == "Work Arrangement", valid_arrangement(answer, onsite_label))
        .otherwise(F.lit(False))
    )


def same(a: Column, b: Column) -> Column:
    """Equality in which a missing side is a difference."""
    return F.coalesce(a == b, F.lit(False))


def reported_salary(prediction: Column) -> Column:
    """The salary in a prediction as the report reads it: three to six digit amounts only."""
    return _found(F.regexp_extract(text_or_empty(prediction), K.REPORTED_SALARY, 0))


PARTS = ("min", "max", "currency", "frequency")


def salary_parts(text: Column) -> Column:
    """Struct (min, max, currency, frequency) of stripped parts; no dash gives nulls."""

    def named(parts: Column) -> Column:
        several = F.size(parts) > 1
        return F.struct(
            *[
                F.when(several, strip(F.get(parts, F.lit(i)))).alias(n)
                for i, n in enumerate(PARTS)
            ]
        )

    return once(F.split(text, "-"), named)


def strict_salary_parts(text: Column) -> Column:
    """As ``salary_parts``, unstripped, for two to four parts; any other count gives nulls."""

    def named(parts: Column) -> Column:
        usable = F.size(parts).between(2, 4)
        return F.struct(
            *[F.when(usable, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(PARTS)]
        )

    return once(F.split(text, "-"), named)
