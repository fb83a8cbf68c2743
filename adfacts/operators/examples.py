"""Training examples from pairs, documents and token annotations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import tokens as X
from adfacts.operators.grouping import running_totals
from adfacts.session import pinned, small_batches

# Tokens frequent enough to overload one join task; past this rank no token can hold more
# than one in HOT_TOKENS of all occurrences.
HOT_TOKENS = 10_000
# Frequent tokens of more letters are joined by a shuffle, where Spark splits hot keys; so what
# is sent to all tasks is at most HOT_TOKENS times this.
HOT_LETTERS = 1_000
# Tokens that a task looks up at once; a row is not split.
LOOKED_UP = 1 << 18
# Rows with the same leading digits that are put in order at once.
ORDERED_ROWS = 100_000


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Ids for all tokens, the most frequent first, equals by spelling."""
    counts = (
        df.select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    order = [F.col("occurrences").desc(), F.col("token")]
    ranked = running_totals(counts, [], order, {"earlier": F.lit(1)})
    return ranked.select(
        "token", "occurrences", (F.coalesce("earlier", F.lit(0)) + X.FIRST_ID).alias("id")
    )


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of rows with up to ``most`` tokens; more only of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield start, stop - start
        start = stop


def encoded(df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``input_ids`` per row, in token order; unknown tokens are left out.

    ``vocab`` is read several times, so it had better be a written table. The most frequent
    tokens are looked up within the array, a batch of rows at a time. Of the others, each is
    joined once per row, by its place among the row's own, and the array is filled up.
    """
    vocab = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    is_frequent = (F.col("_id") < X.FIRST_ID + HOT_TOKENS) & (F.length("_token") <= HOT_LETTERS)
    rows = vocab.filter(is_frequent).toArrow()
    frequent = df.sparkSession.sparkContext.broadcast(
        (rows.column("_token").combine_chunks(), rows.column("_id").to_numpy())
    )
    kind = df.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for start, n in _runs(sizes, LOOKED_UP):
                yield batch.slice(start, n)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        known, ids_of = frequent.value
        for batch in pieces(batches):
            n, lists = batch.num_rows, batch.column(1)
            values = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy()
            rare = at < 0
            ids = np.full(len(at), -1, np.int64)
            ids[~rare] = ids_of[at[~rare]]
            # Rare tokens of a row once each, by spelling; a token's place among them, negative.
            names = values.filter(pa.array(rare)).dictionary_encode()
            of_row = np.repeat(np.arange(n), sizes)[rare]
            codes = names.indices.fill_null(len(names.dictionary)).to_numpy()
            width = len(names.dictionary) + 1
            pairs, which = np.unique(of_row * width + codes, return_inverse=True)
            starts = np.searchsorted(pairs // width, np.arange(n + 1))
            ids[rare] = starts[of_row] - which - 1
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            spelled = pa.chunked_array([names.dictionary, pa.nulls(1, values.type)]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + n)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), spelled.take(pa.array(pairs % width)))],
                names=[key, "_row", "_ids", "_rare"],
            )
            row += n

    schema = f"`{key}` {kind}, _row bigint, _ids array<bigint>, _rare array<string>"
    with small_batches(df.sparkSession):
        looked_up = pinned(df.select(key, tokens).mapInArrow(look_up, schema))
    others = vocab.filter(~is_frequent)
    filled = (
        looked_up.select("_row", F.posexplode("_rare").alias("_place", "_token"))
        .join(others, "_token", "left")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_id")))["_id"].alias("_found"))
    )
    ids = F.transform("_ids", lambda i: F.when(i >= 0, i).otherwise(F.get("_found", (-1 - i).cast("int"))))
    return (
        looked_up.select(key, "_row", "_ids").join(filled, "_row", "left")
        .select(key, F.array_compact(ids).alias("input_ids"))
    )


def supervised(
    df: DataFrame,
    prompt_ids: Column,
    answer_ids: Column,
    length: int = K.EXAMPLE_LENGTH,
    cap: int | None = None,
    pad: int = X.PAD,
    end: int = X.END,
) -> DataFrame:
    """Encoded pairs with attention mask and labels in which the prompt is ignored.

    ``cap`` is the most prompt places to ignore; by default one less than ``length``, so
    that one label always stays.
    """
    whole = F.slice(F.concat(prompt_ids, answer_ids, F.array(F.lit(end))), 1, length)
    cap = length - 1 if cap is None else cap
    return (
        df.withColumns({"_ids": whole, "_prompt": F.size(prompt_ids)})
        .withColumns(
            {
                "input_ids": X.pad_right(F.col("_ids"), length, F.lit(pad)),
                "attention_mask": X.attention_mask(F.col("_ids"), length),
            }
        )
        .withColumn(
            "labels",
            X.masked_prompt(F.col("input_ids"), F.col("_prompt"), F.lit(K.IGNORED), cap),
        )
        .drop("_ids", "_prompt")
    )


def _finished(df: DataFrame, cut: Column, class_id: Column, kind: int, pad: int) -> DataFrame:
    """Pad ``_ids`` to the window; ignore ``cut`` places and all pads in the labels."""
    size = K.WINDOW_LENGTH
    return (
        df.withColumns(
            {
                "input_ids": X.pad_right(F.col("_ids"), size, F.lit(pad)),
                "attention_mask": X.attention_mask(F.col("_ids"), size),
                "_cut": cut,
            }
        )
        .withColumn(
            "labels",
            X.ignore_value(
                X.masked_prompt(F.col("input_ids"), F.col("_cut"), F.lit(K.IGNORED), size),
                F.lit(pad),
                F.lit(K.IGNORED),
            ),
        )
        .withColumns({"cls_labels": class_id, "task_type_id": F.lit(kind)})
        .drop("_ids", "_cut")
    )


def class_id(label: Column, classes: list[str] = K.ARRANGEMENT_CLASSES) -> Column:
    """Position of the capitalised label among the classes, null if it is none of them."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), X.capitalised(label))
    return F.when(at > 0, at - 1).cast("int")


def classification(
    df: DataFrame, text_ids: Column, label_ids: Column, label: Column, pad: int = X.PAD
) -> DataFrame:
    """One example per row: the ends of the text, then the label's own tokens."""
    ids = X.keep_ends(F.concat(text_ids, label_ids))
    cut = F.least(F.size(text_ids), F.lit(K.HEAD_LENGTH))
    return _finished(df.withColumn("_ids", ids), cut, class_id(label), 1, pad)


def generation(
    df: DataFrame, prompt_ids: Column, full_ids: Column, pad: int = X.PAD
) -> DataFrame:
    """Overlapping windows over each row; only the first ignores the prompt.

    A row that fits one window gives one example, however short. Longer rows drop windows
    below the shortest length, which can only be the last ones.
    """
    n = F.size("_full")
    starts = F.when(
        n > K.WINDOW_LENGTH, F.sequence(F.lit(0), n - 1, F.lit(K.STRIDE))
    ).otherwise(F.array(F.lit(0)))
    windows = (
        df.withColumns({"_full": full_ids, "_prompt": F.size(prompt_ids)})
        .withColumn("start", F.explode(starts))
        .withColumn("_ids", F.slice(F.col("_full"), F.col("start") + 1, K.WINDOW_LENGTH))
        .filter((n <= K.WINDOW_LENGTH) | (F.size("_ids") >= K.SHORTEST_CHUNK))
    )
    cut = F.when(F.col("start") == 0, F.col("_prompt")).otherwise(F.lit(0))
    return _finished(windows, cut, F.lit(K.IGNORED), 0, pad).drop("_full", "_prompt")


def routed(
    df: DataFrame,
    task: str,
    text_ids: Column,
    label_ids: Column,
    label: Column,
    prompt_ids: Column,
    full_ids: Column,
    class_task: str = "work_arrangement",
) -> DataFrame:
    """Classification rows and generation rows, each its own way, in one table."""
    is_class = F.lower(F.col(task)) == class_task
    one = classification(df.filter(is_class), text_ids, label_ids, label).withColumn(
        "start", F.lit(0)
    )
    many = generation(df.filter(F.coalesce(~is_class, F.lit(True))), prompt_ids, full_ids)
    return one.unionByName(many)


def padded_batches(
    df: DataFrame, batch: str, pad: int = X.PAD, ids: str = "input_ids"
) -> DataFrame:
    """Every sequence of a batch padded to its longest; a missing scalar becomes ignored.

    A batch is what a model takes at once, so it is small.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    joined = df.withColumn("_longest", longest)
    values = {ids: pad, "attention_mask": pad, "labels": K.IGNORED}
    out = {
        name: X.pad_right(
            F.coalesce(F.col(name), F.array().cast("array<int>")), F.col("_longest"), F.lit(value)
        )
        for name, value in values.items()
        if name in df.columns
    }
    scalars = {
        name: F.coalesce(F.col(name), F.lit(K.IGNORED))
        for name in ("cls_labels", "task_type_id")
        if name in df.columns
    }
    return joined.withColumns({**out, **scalars}).drop("_longest")


def _drawn(key: Column, seed: int) -> Column:
    """A number below 16^15 that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 55) -> DataFrame:
    """``split`` per row by a hash of its key; about ``fraction`` of the rows validate.

    Rows without a key train.
    """
    bound = int(fraction * 16**15)
    held_out = _drawn(F.col(key), seed) < bound
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def exact_split(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 55) -> DataFrame:
    """As ``hash_split`` with exactly the rounded-up share of all rows in validation.

    Rows without a key count for the share and train; if fewer have a key than the share asks for,
    all of those validate. The last held-out row is found on the keys alone: counts per leading
    digits of the drawn number say which digits it has, and only their rows are put in order. The
    table itself is only projected.
    """
    place = F.struct(_drawn(F.col(key), seed).alias("_drawn"), F.col(key).alias("_key"))
    every = df.select(place.alias("_place")).select("_place.*")
    rows = every.filter(F.col("_key").isNotNull())
    known, size = every.agg(F.count("_key"), F.count(F.lit(1))).first()
    left = min(math.ceil(size * fraction), known)
    for digits in (4, 8, 12, 15) if left else ():
        lead = F.floor(F.col("_drawn") / F.lit(16 ** (15 - digits))).cast("bigint")
        counts = rows.groupBy(lead.alias("_lead")).agg(F.count(F.lit(1)).alias("_rows"))
        upto = F.sum("_rows").over(Window.orderBy("_lead"))
        cut = (
            counts.withColumn("_upto", upto).filter(F.col("_upto") >= left)
            .orderBy("_lead").limit(1).first()
        )
        left -= cut["_upto"] - cut["_rows"]
        rows = rows.filter(lead == cut["_lead"])
        if cut["_rows"] <= ORDERED_ROWS:
            break
    last = rows.orderBy("_drawn", "_key").limit(left)
    bound = last.agg(F.max(F.struct("_drawn", "_key"))).scalar()
    held_out = F.col(key).isNotNull() & (place <= bound)
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


# --- annotated tokens ----------------------------------------------------------------


def tagged_token(token: Column, pos_tag: Column, entity: Column) -> Column:
    return (
        F.when(F.coalesce(entity, F.lit("")) != "", F.concat_ws("_", token, entity))
        .when(pos_tag == "ADJ", F.concat(token, F.lit("_ADJ")))
        .otherwise(token)
    )


def tagged_prompts(
    pairs: DataFrame, annotations: DataFrame, key: str, end_mark: str = "<end>"
) -> DataFrame:
    """Pairs as one text with marked entities and adjectives, and the prompt's token count."""
    piece = tagged_token(F.col("token"), F.col("pos_tag"), F.col("ent"))
    prompts = (
        annotations.select(key, F.struct("pos", piece.alias("piece")).alias("_piece"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
        .select(key, F.col("_pieces.piece").alias("_pieces"))
    )
    empty = F.array().cast("array<string>")
    return (
        pairs.join(prompts, key, "left")
        .withColumn("_pieces", F.coalesce("_pieces", empty))
        .withColumns(
            {
                "text": F.concat_ws(
                    " ", F.array_join("_pieces", " "), F.col("complete"), F.lit(end_mark)
                ),
                "prompt_tokens": F.size("_pieces"),
            }
        )
        .drop("_pieces")
    )


def tag_arrays(
    pairs: DataFrame, annotations: DataFrame, key: str, length: int = K.TAG_IDS_LENGTH
) -> DataFrame:
    """Tag id arrays of fixed length. Tokens past the end are dropped before the shuffle."""
    kept = annotations.filter(F.col("pos") < length - K.LEADING_TAG_PADS)
    entity = F.when(F.coalesce("ent", F.lit("")) == "", F.lit("O")).otherwise(F.col("ent"))
    tags = (
        kept.select(key, F.struct("pos", F.col("pos_tag"), entity.alias("ent")).alias("_tag"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_tag")).alias("_tags"))
    )
    empty = F.array().cast("array<string>")

    def ids(field: str, names: list[str]) -> Column:
        values = F.coalesce(F.col(f"_tags.{field}"), empty)
        return X.padded_tags(X.tag_ids(values, names), length)

    return (
        pairs.join(tags, key, "left")
        .withColumns({"pos_ids": ids("pos_tag", K.POS_TAGS), "ner_ids": ids("ent", K.ENTITY_TAGS)})
        .drop("_tags")
    )
