"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is two log odds, of low quality and of toxicity, by logistic
regressions on a dozen measures of the text and on the words that tell labelled classes apart.
They are fitted on at most ``SAMPLE`` labelled documents, those with the lowest hash of their id.
The share of bad documents of a host and of a path on it is estimated over all documents, from
their own probabilities, by grouped sums: a path is shrunk to its host, a host to the corpus, each
by a prior whose strength is the method-of-moments estimate of how much groups differ. The odds
of the path then replace those of the corpus in a document's odds.

For ``documents`` the host is the source and the path its language. Sums combine before the
shuffle, and documents get the numbers of their path without moving by it (up to a counted
number of paths; more are joined by key), so a hot source does no harm.

Defined results: null and empty texts are measured as empty; null hosts and paths are groups of
their own; without labels of both classes a document's own odds are even at that rate (nothing is
rejected); labels of absent documents, null labels and repeated labels (the highest counts) are
no evidence; rows alike in id and text are decided alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfacts.llm.common import decided, settled, table, text_key, with_group_values, words, written

SAMPLE = 20_000
TERMS = 20_000
LEAST_CHI = 25.0
LEAST_DOCS = 5
THRESHOLD = 0.5
KINDS = ["low", "toxic"]

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"
STOPS = b".,;:?"


def _number(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def measures(text: bytes, found: list[bytes], kinds: set[bytes]) -> list[float]:
    """What is measured of a text; ``found`` are its words, ``kinds`` the distinct ones."""
    size, n = max(len(text), 1), max(len(found), 1)
    letters = max(_number(text, LETTERS), 1)
    lines = text.split(b"\n")
    repeats = sum(map(eq, found, found[1:]))
    top = Counter(found).most_common(1)[0][1] if found else 0
    return [
        np.log1p(len(found)),
        sum(map(len, found)) / n,
        _number(text, UPPER) / letters,
        _number(text, DIGITS) / size,
        _number(text, SYMBOLS) / size,
        _number(text, STOPS) / n,
        letters / size,
        len(kinds) / n,
        len(kinds) / np.sqrt(n),
        repeats / n,
        top / n,
        len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
    ]


N_MEASURES = 13


def terms_of(kinds: set[bytes]) -> set[bytes]:
    """Distinct words and their beginnings, which stand for families of words."""
    return kinds | {b"^" + w[:k] for w in kinds for k in (4, 5) if len(w) > k}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, low, toxic) of the labelled documents with the lowest hashes, written once."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((1 - F.min("quality")).alias("low"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
        # Labels of absent documents would use up the sample.
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(
        texts.join(F.broadcast(known), "doc_id").select(
            "text", *[F.col(k).cast("int").alias(k) for k in KINDS]
        ),
        "labelled",
    )


def telling_terms(sample: DataFrame) -> dict[bytes, tuple[float, float]]:
    """Log likelihood ratios for both kinds of the ``TERMS`` most telling terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[Counter] = [Counter(), Counter(), Counter()]
            for text, low, toxic in zip(*batch.columns):
                terms = terms_of(set(words(text.as_py())))
                n[0].update(terms)
                if low.as_py():
                    n[1].update(terms)
                if toxic.as_py():
                    n[2].update(terms)
            terms = list(n[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.binary()), *[pa.array([c[t] for t in terms], pa.int64()) for c in n]],
                names=["term", "n", "low", "toxic"],
            )

    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS]).first()
    if not totals["n"]:
        return {}
    counts = (
        sample.mapInArrow(count, "term binary, n long, low long, toxic long")
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)])
        .filter(F.col("n") >= LEAST_DOCS)
    )

    def chi(kind: str) -> Column:
        n, bad = float(totals["n"]), float(totals[kind])
        a, row = F.col(kind).cast("double"), F.col("n").cast("double")
        off = a * n - row * bad
        return off * off * n / (row * (n - row) * bad * (n - bad)) if 0 < bad < n else F.lit(0.0)

    def ratio(kind: str) -> Column:
        n, bad = float(totals["n"]), float(totals[kind])
        inside = (F.col(kind) + 0.5) / (bad + 1)
        outside = (F.col("n") - F.col(kind) + 0.5) / (n - bad + 1)
        return F.when(F.coalesce(chi(kind), F.lit(0.0)) >= LEAST_CHI, F.log(inside / outside)).otherwise(0.0)

    best = F.greatest(*[F.coalesce(chi(k), F.lit(0.0)) for k in KINDS])
    rows = (
        counts.withColumn("_best", best).filter(F.col("_best") >= LEAST_CHI)
        .orderBy(F.desc("_best"), "term").limit(TERMS)
        .select("term", *[ratio(k).alias(k) for k in KINDS]).collect()
    )
    return {bytes(r["term"]): (r["low"], r["toxic"]) for r in rows}


def features(text: bytes | None, telling: dict[bytes, tuple[float, float]]) -> list[float]:
    """Measures of a text and its sums of telling terms, for both kinds."""
    text = text or b""
    found = words(text)
    kinds = set(found)
    low = toxic = 0.0
    for term in terms_of(kinds) & telling.keys():
        ratios = telling[term]
        low += ratios[0]
        toxic += ratios[1]
    return [*measures(text, found, kinds), np.clip(low, -20, 20), np.clip(toxic, -20, 20)]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the constant."""
    if not 0 < y.sum() < len(y):
        return np.zeros(x.shape[1] + 1)
    x = np.column_stack([x, np.ones(len(x))])
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Evidence:
    """A document's own log odds of being of low quality and of being toxic."""

    def __init__(self, telling: dict, x: np.ndarray, labels: np.ndarray):
        self.telling = telling
        self.mean = x.mean(0) if len(x) else np.zeros(N_MEASURES + 2)
        self.scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(N_MEASURES + 2)
        scaled = (x - self.mean) / self.scale
        self.weights = [fitted(scaled, labels[:, k]) for k in range(len(KINDS))]
        self.known = [bool(len(x)) and 0 < labels[:, k].sum() < len(x) for k in range(len(KINDS))]

    def odds(self, texts: Iterable[bytes | None]) -> list[np.ndarray]:
        """Both log odds of each text; texts are taken one by one."""
        x = np.array([features(t, self.telling) for t in texts]).reshape(-1, N_MEASURES + 2)
        scaled = np.clip((x - self.mean) / self.scale, -50, 50)
        return [
            np.clip(scaled @ w[:-1] + w[-1], -30, 30) if known else np.full(len(x), -30.0)
            for w, known in zip(self.weights, self.known)
        ]


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Fitted on the driver: a row of some fifteen numbers per document of the bounded sample."""
    rows = labelled_sample(docs, labels, sample)
    telling = telling_terms(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), telling) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                names=["x", *KINDS],
            )

    measured = rows.mapInArrow(measure, "x array<double>, low int, toxic int").toArrow()
    x = np.array(measured.column("x").to_pylist()).reshape(-1, N_MEASURES + 2)
    return Evidence(telling, x, np.column_stack([measured.column(k).to_numpy() for k in KINDS]))


def _strength(groups: DataFrame, kind: str, mean: Column) -> Column:
    """Prior strength in documents by the method of moments, from 1 to a million."""
    n, rate = F.col("n"), F.col(kind) / F.col("n")
    spread = F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n)
    chance = mean * (1 - mean) * F.count(F.lit(1)) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1e6))


def shrunk(own: DataFrame) -> DataFrame:
    """(host, path, low, toxic): per path the log odds that its share adds to a document's.

    ``own`` has host, path and each document's own probabilities.
    """
    paths = written(
        own.groupBy("host", "path").agg(
            F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(k).alias(k) for k in KINDS]
        ),
        "paths",
    )
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in KINDS]).first()
    rows = total["n"] or 1.0
    means = {k: min(max((total[k] or 0.0) / rows, 1e-9), 1 - 1e-9) for k in KINDS}

    def strengths(groups: DataFrame) -> dict[str, float]:
        found = groups.agg(*[_strength(groups, k, F.lit(means[k])).alias(k) for k in KINDS]).first()
        return {k: found[k] or 1.0 for k in KINDS}

    of_hosts, of_paths = strengths(hosts), strengths(paths)
    posterior = hosts.select(
        F.col("host").alias("_host"),
        *[
            ((F.col(k) + of_hosts[k] * means[k]) / (F.col("n") + of_hosts[k])).alias(f"_{k}")
            for k in KINDS
        ],
    )

    def added(kind: str) -> Column:
        share = (F.col(kind) + of_paths[kind] * F.col(f"_{kind}")) / (F.col("n") + of_paths[kind])
        share = F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(share / (1 - share)) - float(np.log(means[kind] / (1 - means[kind])))

    return paths.join(posterior, F.col("host").eqNullSafe(F.col("_host"))).select(
        "host", "path", *[added(k).alias(k) for k in KINDS]
    )


def scored(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, _key, p_quality, p_toxic, keep) of every document."""
    return settled(docs.sparkSession, lambda: _scored(docs, labels, host, path, sample), "scored")


def _scored(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int
) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learned(docs, labels, sample))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.value.odds(t.as_py() for t in batch.column("text"))
            kept = [batch.column(c) for c in ("doc_id", "_key", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(o, pa.float64()) for o in odds]],
                names=["doc_id", "_key", "host", "path", "own_low", "own_toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(
        "doc_id", text_key().alias("_key"), host.cast("string").alias("host"),
        path.cast("string").alias("path"), F.col("text").cast("binary").alias("text"),
    )
    own = written(
        read.mapInArrow(
            measure,
            f"doc_id {kind}, _key long, host string, path string, own_low double, own_toxic double",
        ),
        "evidence",
    )

    def chance(odds: Column) -> Column:
        return 1 / (1 + F.exp(-odds))

    rates = shrunk(own.select("host", "path", *[chance(F.col(f"own_{k}")).alias(k) for k in KINDS]))
    bad = {k: chance(F.col(f"own_{k}") + F.col(k)) for k in KINDS}
    return with_group_values(own, rates, ["host", "path"]).select(
        "doc_id", "_key", (1 - bad["low"]).alias("p_quality"), bad["toxic"].alias("p_toxic"),
        ((bad["low"] <= THRESHOLD) & (bad["toxic"] <= THRESHOLD)).alias("keep"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are neither of low quality nor toxic."""
    rejected = scored(docs, labels, F.col("source"), F.col("lang")).filter(~F.col("keep"))
    return decided(docs, rejected.select("doc_id", "_key"), "left_anti", text_key())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, labels, F.col("source"), F.col("lang")).drop("_key")


QUERIES = {"op5_quality": op5_quality}
CHECKS: dict[str, str] = {}
