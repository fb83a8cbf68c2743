"""Token arrays: cutting, padding and masking examples.

Ids may be of any type; the padding value and the ignored label are given as Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adfacts import constants as K

TOKEN = r"[\p{L}\p{N}]+|[^\x09-\x0d\x20\p{L}\p{N}]"
PAD = 0
END = 1
FIRST_ID = 2


def tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def filled(value: Column, n: Column) -> Column:
    return F.array_repeat(value, F.greatest(n, F.lit(0)).cast("int"))


def pad_right(ids: Column, length: Column | int, pad: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, filled(pad, length - F.size(ids)))


def attention_mask(ids: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(filled(F.lit(1), F.size(ids)), filled(F.lit(0), length - F.size(ids)))


def masked_prompt(ids: Column, prompt_size: Column, ignored: Column, cap: int) -> Column:
    """Labels: ``ids`` with at most ``cap`` leading places of the prompt ignored."""
    hidden = F.least(prompt_size, F.lit(cap), F.size(ids))
    rest = F.slice(ids, hidden + 1, F.size(ids))
    return F.concat(filled(ignored, hidden), rest)


def keep_ends(
    ids: Column, length: int = K.WINDOW_LENGTH, head: int = K.HEAD_LENGTH, tail: int = K.TAIL_LENGTH
) -> Column:
    """A sequence longer than ``length`` keeps its first ``head`` and last ``tail`` ids."""
    ends = F.concat(F.slice(ids, 1, head), F.slice(ids, -tail, tail))
    return F.when(F.size(ids) > length, ends).otherwise(ids)


def ignore_value(labels: Column, value: Column, ignored: Column) -> Column:
    return F.transform(labels, lambda x: F.when(x == value, ignored).otherwise(x))


def align_left(ids: Column, length: Column, pad: Column) -> Column:
    """Exactly ``length`` ids: pads go in front, a surplus is cut from the front."""
    missing = length - F.size(ids)
    last = F.slice(ids, F.size(ids) - length + 1, length)
    return F.when(missing >= 0, F.concat(filled(pad, missing), ids)).otherwise(last)


def tag_ids(tags: Column, vocabulary: list[str]) -> Column:
    """Position of each tag in the vocabulary; unknown tags get 0."""
    known = F.array(*[F.lit(t) for t in vocabulary])

    def position(tag: Column) -> Column:
        at = F.array_position(known, tag)
        return F.when(at > 0, at - 1).otherwise(F.lit(0)).cast("int")

    return F.transform(tags, position)


def padded_tags(ids: Column, length: int, front: int = K.LEADING_TAG_PADS) -> Column:
    """Tag ids behind ``front`` pads, cut or padded to ``length``; no ids gives all pads."""
    shifted = F.concat(filled(F.lit(PAD), F.lit(front)), ids)
    return pad_right(F.slice(shifted, 1, length), length, F.lit(PAD))


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
