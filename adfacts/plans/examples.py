"""Queries over training examples. Arrays are compared as space-separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import tokens as X
from adfacts.operators import examples as E
from adfacts.operators import pairs as P
from adfacts.plans import checksql as C
from adfacts.plans.registry import register
from adfacts.session import pinned


def _ids(text: str | Column) -> Column:
    """Stand-in for a model's tokenizer: an id from the spelling of each token."""

    def spelled(t: Column) -> Column:
        last = F.ascii(F.right(t, F.lit(1)))
        number = F.length(t) * 7919 + F.ascii(t).cast("bigint") * 104729 + last * 1299709
        return (number % 150_000 + X.FIRST_ID).cast("int")

    return F.transform(X.tokens(F.col(text) if isinstance(text, str) else text), spelled)


def _as_text(
    df: DataFrame, *keys: str, arrays: list[str], others: Sequence[str] = ()
) -> DataFrame:
    texts = [F.array_join(F.col(a).cast("array<string>"), " ").alias(a) for a in arrays]
    return df.select(*keys, *others, *texts)


# --- vocabulary ------------------------------------------------------------------------

VOCABULARY = f"""counts AS (SELECT token, count(*) AS occurrences
  FROM (SELECT unnest({C.tokens("text")}) AS token FROM documents) GROUP BY 1),
vocab AS (SELECT token, occurrences, row_number() OVER (ORDER BY occurrences DESC, encode(token)) + 1 AS id FROM counts)"""


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.tokens(F.col("text")).alias("tokens"))


@register(
    "ex1_vocabulary", "documents",
    f"WITH {VOCABULARY} SELECT token, occurrences, id FROM vocab",
    heavy=True,
)
def ex1_vocabulary(documents: DataFrame) -> DataFrame:
    return E.vocabulary(_documents(documents))


@register(
    "ex1_encoded", "documents",
    f"""WITH {VOCABULARY},
places AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS place
  FROM (SELECT doc_id, {C.tokens("text")} AS t FROM documents))
SELECT doc_id, string_agg(id, ' ' ORDER BY place) AS input_ids FROM places JOIN vocab USING (token) GROUP BY 1""",
    heavy=True,
)
def ex1_encoded(documents: DataFrame) -> DataFrame:
    docs = _documents(documents)
    vocab = pinned(E.vocabulary(docs))
    return _as_text(E.encoded(docs, vocab, "doc_id"), "doc_id", arrays=["input_ids"])


# --- supervised pairs --------------------------------------------------------------------

ENCODED_PAIRS = f"""e AS (SELECT pair_id, conv_id, {C.spelled_ids(C.tokens("prompt"))} AS p,
    {C.spelled_ids(C.tokens("complete"))} AS c FROM pairs),
cut AS (SELECT *, list_concat(list_concat(p, c), [1])[1:512] AS ids FROM e),
full_ids AS (SELECT *, {C.padded("ids", "512")} AS input_ids FROM cut)"""


def _supervised(pairs: DataFrame, **more) -> DataFrame:
    return E.supervised(pairs, _ids("prompt"), _ids("complete"), **more)


@register(
    "ex2_supervised_ids", "pairs",
    f"WITH {ENCODED_PAIRS} SELECT pair_id, {C.joined('input_ids')} AS input_ids FROM full_ids",
    heavy=True,
)
def ex2(pairs: DataFrame) -> DataFrame:
    return _as_text(_supervised(pairs), "pair_id", arrays=["input_ids"])


@register(
    "ex3_attention_mask", "pairs",
    f"""WITH {ENCODED_PAIRS} SELECT pair_id, array_to_string(list_transform(range(1, 513),
  lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask FROM full_ids""",
    heavy=True,
)
def ex3(pairs: DataFrame) -> DataFrame:
    return _as_text(_supervised(pairs), "pair_id", arrays=["attention_mask"])


def _masked(cap: int) -> str:
    return f"""WITH {ENCODED_PAIRS} SELECT pair_id, array_to_string(list_transform(input_ids,
  lambda x, i: CASE WHEN i <= least(len(p), {cap}) THEN -100 ELSE x END), ' ') AS labels FROM full_ids"""


@register("ex4_label_mask", "pairs", _masked(511), heavy=True)
def ex4(pairs: DataFrame) -> DataFrame:
    return _as_text(_supervised(pairs), "pair_id", arrays=["labels"])


@register("ex4_label_mask_high_cap", "pairs", _masked(2047), heavy=True)
def ex4_high_cap(pairs: DataFrame) -> DataFrame:
    return _as_text(_supervised(pairs, cap=2047), "pair_id", arrays=["labels"])


# --- long documents ------------------------------------------------------------------------

WINDOW = f"""d AS (SELECT doc_id, complete, task_type, {C.spelled_ids(C.tokens("prompt"))} AS p,
    {C.spelled_ids(C.tokens("complete"))} AS c,
    {C.spelled_ids(C.tokens("upper(complete[1]) || lower(complete[2:])"))} AS capital FROM corpus)"""
KEPT = "CASE WHEN len({x}) > 1024 THEN list_concat({x}[1:896], {x}[-128:]) ELSE {x} END"


@register(
    "ex5_keep_ends", "corpus",
    f"""WITH {WINDOW} SELECT doc_id, len(p)::INTEGER AS n, {C.joined(KEPT.format(x="p"))} AS input_ids FROM d""",
    heavy=True,
)
def ex5(corpus: DataFrame) -> DataFrame:
    df = corpus.select("doc_id", _ids("prompt").alias("p"))
    df = df.select("doc_id", F.size("p").alias("n"), X.keep_ends(F.col("p")).alias("input_ids"))
    return _as_text(df, "doc_id", arrays=["input_ids"], others=["n"])


CLASSES = f"""text_ids AS (SELECT *, list_concat(p, [1]) AS t, list_concat(capital, [1]) AS l FROM d),
ends AS (SELECT *, {KEPT.format(x="list_concat(t, l)")} AS ids FROM text_ids),
classed AS (SELECT doc_id, 0 AS start, ids, {C.padded("ids", "1024")} AS input_ids, least(len(t), 896) AS cut,
  CASE lower(complete) WHEN 'onsite' THEN 0 WHEN 'remote' THEN 1 WHEN 'hybrid' THEN 2 END AS cls_labels,
  1 AS task_type_id, task_type FROM ends)"""
CHUNKS = f"""whole AS (SELECT doc_id, task_type, p, list_concat(list_concat(p, c), [1]) AS f FROM d),
starts AS (SELECT *, unnest(CASE WHEN len(f) > 1024 THEN range(0, len(f), 896) ELSE [0] END) AS start FROM whole),
sliced AS (SELECT *, f[start + 1:start + 1024] AS ids FROM starts),
chunked AS (SELECT doc_id, start::INTEGER AS start, ids, {C.padded("ids", "1024")} AS input_ids,
  CASE WHEN start = 0 THEN len(p) ELSE 0 END AS cut, -100 AS cls_labels, 0 AS task_type_id, task_type
  FROM sliced WHERE len(f) <= 1024 OR len(ids) >= 128)"""
SHOWN = f"""doc_id, start, cls_labels, task_type_id, {C.joined("input_ids")} AS input_ids,
  len(ids)::INTEGER AS filled, array_to_string(list_transform(input_ids,
    lambda x, i: CASE WHEN i <= cut OR x = 0 THEN -100 ELSE x END), ' ') AS labels"""


def _example_text(df: DataFrame) -> DataFrame:
    first_pad = F.array_position("attention_mask", 0)
    filled = F.when(first_pad > 0, first_pad - 1).otherwise(F.size("attention_mask")).cast("int")
    return _as_text(
        df.withColumn("filled", filled),
        "doc_id", "start",
        arrays=["input_ids", "labels"],
        others=["cls_labels", "task_type_id", "filled"],
    )


def _with_end(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(X.END)))


def _label_ids() -> Column:
    return _with_end(_ids(X.capitalised(F.col("complete"))))


def _routed(corpus: DataFrame) -> DataFrame:
    ids = corpus.withColumns({"_p": _ids("prompt"), "_c": _ids("complete")})
    p, c = F.col("_p"), F.col("_c")
    return E.routed(
        ids, "task_type",
        text_ids=_with_end(p), label_ids=_label_ids(), label=F.col("complete"),
        prompt_ids=p, full_ids=_with_end(F.concat(p, c)),
    ).drop("_p", "_c")


@register(
    "ex6_classification", "corpus",
    f"WITH {WINDOW}, {CLASSES} SELECT {SHOWN} FROM classed WHERE task_type = 'work_arrangement'",
    heavy=True,
)
def ex6(corpus: DataFrame) -> DataFrame:
    rows = corpus.filter("task_type = 'work_arrangement'")
    text = _with_end(_ids("prompt"))
    examples = E.classification(rows, text, _label_ids(), F.col("complete"))
    return _example_text(examples.withColumn("start", F.lit(0)))


@register(
    "ex7_generation_chunks", "corpus",
    f"WITH {WINDOW}, {CHUNKS} SELECT {SHOWN} FROM chunked",
    heavy=True,
)
def ex7(corpus: DataFrame) -> DataFrame:
    ids = corpus.withColumns({"_p": _ids("prompt"), "_c": _ids("complete")})
    full = _with_end(F.concat("_p", "_c"))
    return _example_text(E.generation(ids, F.col("_p"), full))


@register(
    "ex8_routed_examples", "corpus",
    f"""WITH {WINDOW}, {CLASSES}, {CHUNKS} SELECT {SHOWN} FROM classed WHERE task_type = 'work_arrangement'
UNION ALL SELECT {SHOWN} FROM chunked WHERE task_type <> 'work_arrangement'""",
    heavy=True,
)
def ex8(corpus: DataFrame) -> DataFrame:
    return _example_text(_routed(corpus))


@register(
    "pf9_class_examples", "corpus",
    f"""WITH {WINDOW}, {CLASSES} SELECT doc_id, cls_labels, {C.joined("input_ids")} AS input_ids
FROM classed WHERE task_type = 'work_arrangement'""",
    heavy=True,
)
def pf9(corpus: DataFrame) -> DataFrame:
    return _as_text(
        P.class_examples(_routed(corpus)), "doc_id", arrays=["input_ids"], others=["cls_labels"]
    )


@register(
    "pf8_longer_than_one", "documents",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, array_to_string({C.spelled_ids(C.tokens("line"))}, ' ') AS input_ids
FROM l WHERE len({C.tokens("line")}) > 1""",
    heavy=True,
)
def pf8(documents: DataFrame) -> DataFrame:
    lines = documents.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).select("doc_id", (F.col("line_no") + 1).alias("line_no"), _ids("line").alias("input_ids"))
    return _as_text(P.longer_than_one(lines), "doc_id", "line_no", arrays=["input_ids"])


@register(
    "ex9_padded_batches", "pairs",
    f"""WITH {ENCODED_PAIRS}, w AS (SELECT *, max(len(p)) OVER (PARTITION BY conv_id) AS m FROM e)
SELECT pair_id, {C.joined(C.padded("p", "m"))} AS input_ids, {C.joined(C.padded("p", "m", "-100"))} AS labels,
  -100 AS cls_labels FROM w""",
)
def ex9(pairs: DataFrame) -> DataFrame:
    ids = pairs.select(
        "pair_id", "conv_id",
        _ids("prompt").alias("input_ids"), _ids("prompt").alias("labels"),
        F.lit(None).cast("int").alias("cls_labels"),
    )
    padded = E.padded_batches(ids, "conv_id")
    return _as_text(padded, "pair_id", arrays=["input_ids", "labels"], others=["cls_labels"])


_DRAWN = "('0x' || substr(md5('55:' || doc_id), 1, 15))::BIGINT"


@register(
    "ex10_hash_split", "documents",
    f"""SELECT doc_id, CASE WHEN {_DRAWN} < {int(0.1 * 16**15)} THEN 'validation' ELSE 'train' END AS split
FROM documents""",
)
def ex10(documents: DataFrame) -> DataFrame:
    return E.hash_split(documents, "doc_id").select("doc_id", "split")


@register(
    "ex10_exact_split", "documents",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAWN}, doc_id) AS place,
    ceil(count(*) OVER () * 0.1::DOUBLE) AS held FROM documents)
SELECT doc_id, CASE WHEN place <= held THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def ex10_exact(documents: DataFrame) -> DataFrame:
    return E.exact_split(documents, "doc_id").select("doc_id", "split")


# --- annotated tokens ------------------------------------------------------------------------

ANNOTATED = f"""a AS (SELECT pair_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT pair_id, {C.tokens("prompt")} AS t FROM pairs)),
annotations AS (SELECT pair_id, pos, token,
  CASE length(token) % 6 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'PUNCT' WHEN 2 THEN 'DET' WHEN 3 THEN 'X'
    WHEN 4 THEN 'NOUN' ELSE 'VERB' END AS pos_tag,
  CASE length(token) % 9 WHEN 0 THEN 'ORG' WHEN 5 THEN 'MONEY' WHEN 8 THEN 'GPE' ELSE '' END AS ent FROM a)"""


def _annotations(pairs: DataFrame) -> DataFrame:
    """Stand-in tags for the prompts' tokens, by token length."""
    size = F.length("token")

    def picked(n: int, tags: dict[int, str], otherwise: str) -> Column:
        chain = F
        for rest, tag in tags.items():
            chain = chain.when(size % n == rest, tag)
        return chain.otherwise(otherwise)

    tokens = pairs.select("pair_id", F.posexplode(X.tokens(F.col("prompt"))).alias("pos", "token"))
    return tokens.withColumns(
        {
            "pos_tag": picked(6, {0: "ADJ", 1: "PUNCT", 2: "DET", 3: "X", 4: "NOUN"}, "VERB"),
            "ent": picked(9, {0: "ORG", 5: "MONEY", 8: "GPE"}, ""),
        }
    )


@register(
    "ex11_tagged_prompts", "pairs",
    f"""WITH {ANNOTATED}, t AS (SELECT pair_id, count(*)::INTEGER AS n, string_agg(
    CASE WHEN ent <> '' THEN token || '_' || ent WHEN pos_tag = 'ADJ' THEN token || '_ADJ' ELSE token END,
    ' ' ORDER BY pos) AS tagged FROM annotations GROUP BY 1)
SELECT pair_id, coalesce(tagged, '') || ' ' || complete || ' <end>' AS text, coalesce(n, 0) AS prompt_tokens
FROM pairs LEFT JOIN t USING (pair_id)""",
)
def ex11(pairs: DataFrame) -> DataFrame:
    tagged = E.tagged_prompts(pairs, _annotations(pairs), "pair_id")
    return tagged.select("pair_id", "text", "prompt_tokens")


def _tag_text(column: str, names: list[str]) -> str:
    value = f"coalesce(list_position({C.listed(names)}, {column}) - 1, 0)"
    return f"list({value} ORDER BY pos)"


TAGS = f"""{ANNOTATED}, g AS (SELECT pair_id, {_tag_text("pos_tag", K.POS_TAGS)} AS pt,
  {_tag_text("CASE WHEN ent = '' THEN 'O' ELSE ent END", K.ENTITY_TAGS)} AS et FROM annotations GROUP BY 1)"""


def _padded_tags(x: str) -> str:
    front = f"list_concat({C.repeated('0', '20')}, coalesce({x}, []))[1:1024]"
    return C.joined(C.padded(front, "1024"))


@register(
    "ex12_tag_arrays", "pairs",
    f"""WITH {TAGS} SELECT pair_id, {_padded_tags("pt")} AS pos_ids, {_padded_tags("et")} AS ner_ids
FROM pairs LEFT JOIN g USING (pair_id)""",
)
def ex12(pairs: DataFrame) -> DataFrame:
    arrays = E.tag_arrays(pairs, _annotations(pairs), "pair_id")
    return _as_text(arrays, "pair_id", arrays=["pos_ids", "ner_ids"])


@register(
    "ex13_align_left", "pairs",
    f"""WITH e AS (SELECT pair_id, {C.spelled_ids(C.tokens("prompt"))} AS p, {C.spelled_ids(C.tokens("complete"))} AS c FROM pairs)
SELECT pair_id, {C.joined(f"CASE WHEN len(p) <= len(c) THEN list_concat({C.repeated('0', 'len(c) - len(p)')}, p) ELSE p[len(p) - len(c) + 1:] END")} AS aligned FROM e""",
)
def ex13(pairs: DataFrame) -> DataFrame:
    ids = pairs.select("pair_id", _ids("prompt").alias("p"), _ids("complete").alias("c"))
    aligned = X.align_left(F.col("p"), F.size("c"), F.lit(X.PAD))
    return _as_text(ids.withColumn("aligned", aligned), "pair_id", arrays=["aligned"])
