"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate; each document's number of copies is drawn from the
Poisson distribution of that mean by inverting it at a number hashed from the document's id,
so any task that is run again draws the same. Copies are exploded and shuffled globally.

Everything is DataFrame functions. The draws need a column of a few numbers per source, which
is broadcast after its rows are counted, so no row moves by its source and a source that holds
a third of all rows does no harm. The one shuffle is by a hash of document and copy number.

Defined results: a null source is a source; a source without a target weight keeps the share it
has; a source without any characters gets no copies (no rate reaches its share); null and empty
texts are drawn like others of their source; rows with the same doc_id get the same number of
copies; extra columns stay, but columns named ``copy`` and ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import OWN, table, with_group_values, written

# Larger means are the sum of several draws with a mean of at most this: exp(-mean) stays exact.
LARGEST_MEAN = 32.0
# P(count > 128) is below 1e-30 at the largest mean.
LAST_COUNT = 128
SEED = "mix-1"
TEMPERATURE = 0.7


def source_sizes(docs: DataFrame) -> DataFrame:
    """Characters per source, over all documents."""
    return docs.groupBy("source").agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("size")
    )


def tempered_targets(sizes: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Target weights proportional to a source's characters to the power of ``temperature``."""
    return sizes.select("source", F.pow(F.col("size"), F.lit(temperature)).alias("weight"))


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean copies per document of each source, so that the mix has as many characters as before."""
    named = targets.select(F.col("source").alias("_source"), "weight")
    both = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
    total = sizes.agg(F.sum("size")).scalar()
    known = both.agg(F.sum(F.when(F.col("weight").isNotNull(), F.col("size")))).scalar()
    weights = both.agg(F.sum("weight")).scalar()
    # Sources with a target share what all of them hold now; the others keep theirs.
    share = F.coalesce(F.col("weight") / weights * (known / total), F.col("size") / total)
    return both.select(
        "source",
        F.when((F.col("size") > 0) & share.isNotNull(), share * total / F.col("size"))
        .otherwise(F.lit(0.0))
        .alias("rate"),
    )


def with_distribution(rates: DataFrame) -> DataFrame:
    """Rates with the number of draws and the cumulative distribution of one draw."""
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    start = F.struct(
        F.exp(-F.col("_mean")).alias("p"),
        F.array(F.exp(-F.col("_mean"))).alias("sums"),
    )

    def next_count(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("_mean") / k
        last = F.element_at(state["sums"], -1)
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(last + p)).alias("sums"))

    sums = F.aggregate(
        F.sequence(F.lit(1), F.lit(LAST_COUNT)).cast("array<double>"),
        start, next_count, lambda state: state["sums"],
    )
    return (
        rates.withColumn("_draws", draws)
        .withColumn("_mean", F.col("rate") / F.col("_draws"))
        .withColumn("_sums", sums)
    )


def _hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts]))


def copies(doc_id: Column, draws: Column, sums: Column) -> Column:
    """The Poisson count of a document: how many cumulative chances its hash lies above."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))

    def draw(i: Column) -> Column:
        hashed = F.conv(F.substring(_hashed(name, i), 1, 13), 16, 10).cast("double")
        return F.size(F.filter(sums, lambda s: s <= hashed / float(1 << 52)))

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda n, i: n + draw(i))


def mixed(
    docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """Copies of documents in shuffled order; ``targets`` has a weight per source.

    Without targets, sources are weighted by their characters to the power of ``temperature``.

    Adds ``copy`` (from 1) and ``shuffle_key``, by whose hash rows are dealt to partitions and
    by which they are sorted there.
    """
    docs = docs.drop("copy", "shuffle_key")
    sizes = written(source_sizes(docs), "sizes")
    if targets is None:
        targets = tempered_targets(sizes, temperature)
    rates = with_distribution(repetition_rates(sizes, targets)).select(
        "source", F.col("_draws").alias(f"{OWN}draws"), F.col("_sums").alias(f"{OWN}sums")
    )
    own = [f"{OWN}{c}" for c in ("draws", "sums", "copies")]
    count = copies(F.col("doc_id"), F.col(own[0]), F.col(own[1]))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return (
        with_group_values(docs, rates, ["source"])
        .withColumn(own[2], count)
        .filter(F.col(own[2]) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(own[2]))))
        .drop(*own)
        .withColumn("shuffle_key", _hashed(F.lit("order"), name, F.col("copy")))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op2_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs.select("doc_id", "text", "lang", "source", "n_chars"))


SQL = f"""
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source
), weights AS (
  SELECT source, size, pow(size, {TEMPERATURE}::DOUBLE) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weights)
    * ((SELECT sum(size) FROM sizes) / (SELECT sum(size) FROM sizes))
    * (SELECT sum(size) FROM sizes) / size ELSE 0.0 END AS rate
  FROM weights
), draws AS (
  SELECT source, rate / greatest(ceil(rate / {LARGEST_MEAN}), 1) AS mean,
    greatest(ceil(rate / {LARGEST_MEAN}), 1)::INT AS draws
  FROM rates
), chances AS (
  SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT source, draws, k, CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1))
                                 WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p
        FROM draws, range({LAST_COUNT + 1}) AS r(k))
), sums AS (
  SELECT source, any_value(draws) AS draws, list(below ORDER BY k) AS below
  FROM chances GROUP BY source
), counted AS (
  SELECT d.*, list_sum([len(list_filter(s.below, lambda b: b <=
      ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i), 1, 13))::BIGINT
      / 4503599627370496.0)) FOR i IN range(1, s.draws + 1)])::INT AS copies
  FROM documents d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""

QUERIES = {"op2_mixed_sources": op2_mixed_sources}
CHECKS = {"op2_mixed_sources": SQL}
