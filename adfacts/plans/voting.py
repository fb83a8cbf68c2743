"""Queries over the word-vector vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts.constants import VOTE_LABELS
from adfacts.operators import vectors as V
from adfacts.operators.evaluate import accuracy
from adfacts.operators.similar import cosine_pairs
from adfacts.plans import checksql as C
from adfacts.plans.registry import register
from adfacts.session import pinned

_LABEL_WORDS = ", ".join(
    f"({i}, {C.quoted(label)}, {C.quoted(word)})"
    for i, label in enumerate(VOTE_LABELS)
    for word in label.split()
)
LABELS = f"""label_words(label_order, label, word) AS (VALUES {_LABEL_WORDS}),
means AS (SELECT label_order, label, place, avg(vector[place]::DOUBLE) AS x
  FROM label_words JOIN word_vectors USING (word), (SELECT unnest(generate_series(1, 64)) AS place)
  GROUP BY 1, 2, 3),
label_vectors AS (SELECT label_order, label, list(x ORDER BY place) AS vector FROM means GROUP BY 1, 2)"""
SCORES = f"""{LABELS},
near AS (SELECT w.word, l.label_order, l.label,
    list_cosine_similarity(w.vector::DOUBLE[], l.vector) AS cosine
  FROM word_vectors w, label_vectors l),
votes AS (SELECT * FROM near WHERE cosine > 0.5),
scores AS (SELECT d.doc_id, v.label_order, sum(v.cosine) AS score
  FROM doc_words d JOIN votes v USING (word) GROUP BY 1, 2),
docs AS (SELECT DISTINCT doc_id FROM doc_words),
dense AS (SELECT doc_id, label_order, label, coalesce(score, 0) AS score
  FROM docs CROSS JOIN (SELECT label_order, label FROM label_vectors)
  LEFT JOIN scores USING (doc_id, label_order)),
shared AS (SELECT *, CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w ELSE 0 END AS share
  FROM dense WINDOW w AS (PARTITION BY doc_id))"""


PLACED = """placed AS (SELECT doc_id, label, row_number() OVER
    (PARTITION BY doc_id ORDER BY round(share, 12) DESC, label_order) AS place FROM shared)"""
# The words of an ad as the documents of the vote.
AD_WORDS = f"""doc_words AS (SELECT ad_id AS doc_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS word
  FROM (SELECT ad_id, {C.tokens(C.strip_tags_lowered("job_title", "job_summary"))} AS t FROM seniority_ads))"""


def _scores(vectors: DataFrame, words: DataFrame) -> DataFrame:
    labels = pinned(V.label_vectors(vectors))
    votes = V.word_votes(vectors, labels, len(VOTE_LABELS))
    return V.label_scores(words, "doc_id", votes, labels, len(VOTE_LABELS))


def _winners(vectors: DataFrame, words: DataFrame) -> DataFrame:
    # Rounded, so that sums of the same votes in another order stay equal.
    shares = F.transform(V.shares(F.col("scores")), lambda s: F.round(s, 12))
    return _scores(vectors, words).select(
        "doc_id", V.winner(shares, VOTE_LABELS).alias("seniority")
    )


@register(
    "rx9_label_vectors", "word_vectors",
    f"WITH {LABELS} SELECT label, (place - 1)::INTEGER AS place, round(x, 6) AS x FROM means",
)
def rx9(vectors: DataFrame) -> DataFrame:
    return (
        V.label_vectors(vectors)
        .select("label", F.posexplode("vector").alias("place", "x"))
        .withColumn("x", F.round("x", 6))
    )


@register(
    "rx10_label_scores", "word_vectors doc_words",
    f"WITH {SCORES} SELECT doc_id, label, round(score, 6) AS score FROM dense WHERE score > 0",
    heavy=True,
)
def rx10(vectors: DataFrame, words: DataFrame) -> DataFrame:
    scores = V.by_label(_scores(vectors, words), "doc_id", "scores", VOTE_LABELS, "score")
    return scores.filter("score > 0").withColumn("score", F.round("score", 6))


@register(
    "rx11_label_shares", "word_vectors doc_words",
    f"WITH {SCORES} SELECT doc_id, label, round(share, 6) AS share FROM shared",
    heavy=True,
)
def rx11(vectors: DataFrame, words: DataFrame) -> DataFrame:
    shared = _scores(vectors, words).withColumn("shares", V.shares(F.col("scores")))
    return V.by_label(shared, "doc_id", "shares", VOTE_LABELS, "share").withColumn(
        "share", F.round("share", 6)
    )


@register(
    "rx12_seniority_vote", "word_vectors doc_words",
    f"WITH {SCORES}, {PLACED} SELECT doc_id, label AS seniority FROM placed WHERE place = 1",
    heavy=True,
)
def rx12(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return _winners(vectors, words)


# The same with a label none of whose words has a vector.
SPARSE = SCORES.replace("word_vectors", "sparse_word_vectors")


@register(
    "rx10_label_scores_sparse", "sparse_word_vectors doc_words",
    f"WITH {SPARSE} SELECT doc_id, label, round(score, 6) AS score FROM dense WHERE score > 0",
    heavy=True,
)
def rx10_sparse(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return rx10(vectors, words)


@register(
    "rx11_label_shares_sparse", "sparse_word_vectors doc_words",
    f"WITH {SPARSE} SELECT doc_id, label, round(share, 6) AS share FROM shared",
    heavy=True,
)
def rx11_sparse(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return rx11(vectors, words)


@register(
    "rx12_seniority_vote_sparse", "sparse_word_vectors doc_words",
    f"WITH {SPARSE}, {PLACED} SELECT doc_id, label AS seniority FROM placed WHERE place = 1",
    heavy=True,
)
def rx12_sparse(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return _winners(vectors, words)


# --- the vote over whole ads -------------------------------------------------------------

def _ad_words(ads: DataFrame) -> DataFrame:
    return V.ad_words(ads, "ad_id", "job_title", "job_summary").withColumnRenamed("ad_id", "doc_id")


@register(
    "rx12_ad_vote", "word_vectors seniority_ads",
    f"WITH {AD_WORDS}, {SCORES}, {PLACED} SELECT doc_id AS ad_id, label AS seniority FROM placed WHERE place = 1",
    heavy=True,
)
def rx12_ads(vectors: DataFrame, ads: DataFrame) -> DataFrame:
    return _winners(vectors, _ad_words(ads)).withColumnRenamed("doc_id", "ad_id")


@register(
    "rx12_ad_vote_accuracy", "word_vectors seniority_ads",
    f"""WITH {AD_WORDS}, {SCORES}, {PLACED}
SELECT round(avg((a.y_true = p.label)::INTEGER), 6) AS accuracy
FROM placed p JOIN seniority_ads a ON a.ad_id = p.doc_id WHERE place = 1""",
    heavy=True,
)
def rx12_accuracy(vectors: DataFrame, ads: DataFrame) -> DataFrame:
    voted = rx12_ads(vectors, ads).join(ads.select("ad_id", "y_true"), "ad_id")
    scored = accuracy(voted, truth="y_true", pred="seniority")
    return scored.withColumn("accuracy", F.round("accuracy", 6))


# --- many labels ----------------------------------------------------------------------------

@register(
    "rx10_many_labels", "embeddings",
    """SELECT a.vec_id, b.vec_id AS label_id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a, embeddings b
WHERE b.vec_id < 10000 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4""",
)
def rx10_many(embeddings: DataFrame) -> DataFrame:
    """Every vector against 10,000 labels."""
    labels = embeddings.filter("vec_id < 10000").select(
        F.col("vec_id").alias("label_id"), F.col("embedding").alias("label_vector")
    )
    found = cosine_pairs(embeddings, "vec_id", "embedding", labels, "label_id", "label_vector", 0.4)
    return found.withColumn("cosine", F.round("cosine", 6))
