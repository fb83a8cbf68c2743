"""A Merkle manifest of documents, with a proof per document, by nested-interval labels.

Every document is a leaf; the leaves of a language, in order of ids, are a tree of ``ARITY`` children
a node, and the roots of the languages, in order, are the leaves of one more tree. Leaves are
ranked without gathering a language: the table is range-partitioned by language and id, so that a
large language spans many slices, and each slice starts from the number of leaves before it.

A node is labelled with the interval of leaf ranks it covers and its level. Levels are taken in
bands of ``BAND``: the nodes of a band that share the leading digits of their first rank (a bucket)
are one subtree of at most 2^(``BAND`` + 1) nodes, whatever the size of the language, and are
hashed and written as one row. Its root is a base node of the next band. Downwards, base nodes are
joined with their bucket, and the nodes whose interval contains theirs are their ancestors. What
is left of a parent's interval without a child's is the interval of the sibling. The proof
of a bucket's root continues that of every node below it.

Defined results: a null in any column is hashed as ``-``; a null language is a language, the first;
null ids come first, rows with equal ids are ordered by their digests and equal rows have a leaf
each, so the digests of a table do not depend on its files; an empty table has no root; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adfacts.functions.values import once
from adfacts.llm.common import table, with_group_values, written

# Levels that are hashed at once.
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "struct<lo:bigint,hi:bigint,digest:string>"
# The sibling's digest, null if the parent has one child; whether it stands to the left.
STEP = "struct<digest:string,left:boolean>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-``, or the byte count of a value and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a document; ``other`` columns take the place of its own."""
    return digest(*[field(other.get(name, F.col(name))) for name in FIELDS])


def tree_key(lang: Column) -> Column:
    """Names of trees, null the first: an empty text, or ``+`` and the language."""
    return F.coalesce(F.concat(F.lit("+"), lang), F.lit(""))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` in the ``tree``, from 0, and the ``height`` of the tree."""
    rows = written(
        leaves.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        # Ascends over the whole table; the upper bits are the slice.
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", 33)),
        "leaves",
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy("tree", "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumns({
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_size": F.sum("_n").over(tree),
        })
        .drop("_n")
    )
    return with_group_values(rows, slices, ["tree", "_slice"]).withColumns({
        "rank": F.col("_at") - F.col("_first") + F.col("_before"),
        "height": F.when(F.col("_size") > 1, F.length(F.bin(F.col("_size") - 1))).otherwise(0),
    }).drop("_at", "_slice", "_first", "_before", "_size")


def _levels(base: Column, count: Column) -> Column:
    """The base nodes of a bucket and the levels above them."""

    def parents(nodes: Column) -> Column:
        def parent(i: Column) -> Column:
            first, second = F.element_at(nodes, i), F.get(nodes, i)
            return F.struct(
                first["lo"].alias("lo"),
                F.coalesce(second["hi"], first["hi"]).alias("hi"),
                digest(first["digest"], F.coalesce(second["digest"], F.lit(""))).alias("digest"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(2)), parent)

    return F.aggregate(
        F.sequence(F.lit(1), count), F.array(base).cast(f"array<array<{NODE}>>"),
        lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))),
    )


def _steps(levels: Column, lo: Column, hi: Column, base: int) -> Column:
    """Siblings on the way from a node up to the root of its bucket, by intervals."""
    # Ancestors or self: the nodes that contain the interval, one a level.
    chain = F.flatten(F.transform(
        levels, lambda level: F.filter(level, lambda n: (n["lo"] <= lo) & (hi <= n["hi"]))
    ))
    first = F.element_at(F.element_at(levels, 1), 1)["lo"]

    def steps(nodes: Column) -> Column:
        def step(child: Column, k: Column) -> Column:
            parent = F.get(nodes, k + 1)
            left = child["lo"] > parent["lo"]
            # The parent's interval without the child's; nothing is left of an only child's parent.
            start = F.when(left, parent["lo"]).when(child["hi"] < parent["hi"], child["hi"] + 1)
            place = F.floor((start - first) / F.pow(F.lit(2.0), k + base)).cast("int")
            sibling = F.get(F.element_at(levels, k + 1), place)["digest"]
            return F.struct(sibling.alias("digest"), left.alias("left"))

        return F.transform(F.slice(nodes, F.lit(1), F.size(nodes) - 1), step)

    # Bound once, as each step reads the chain several times. Of no bucket there are no steps.
    none = F.array().cast(f"array<{STEP}>")
    return F.coalesce(once(chain, steps), none)


@dataclass
class Bands:
    """Written rows (tree, bucket, levels) of every band, and the root of every tree."""

    rows: list[DataFrame]
    roots: DataFrame

    def nodes(self) -> DataFrame | None:
        """(tree, level, lo, hi, digest) of all inner nodes."""
        every = None
        for band, rows in enumerate(self.rows):
            one = (
                rows.select("tree", F.posexplode("levels").alias("_k", "_nodes"))
                .filter(F.col("_k") > 0)
                .select("tree", (F.col("_k") + band * BAND).alias("level"), F.inline("_nodes"))
            )
            every = one if every is None else every.unionByName(one)
        return every


def bands(leaves: DataFrame) -> Bands:
    """The nodes above ``leaves`` (tree, rank, height, digest)."""
    highest = leaves.agg(F.max("height")).first()[0] or 0
    base = leaves.select("tree", "height", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    roots = base.filter("height = 0").select("tree", F.col("digest").alias("root"))
    found = []
    for start in range(0, highest, BAND):
        bucket = F.shiftright("lo", start + BAND).alias("bucket")
        buckets = base.filter(F.col("height") > start).groupBy("tree", "height", bucket).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("base")
        )
        count = F.least(F.lit(BAND), F.col("height") - start)
        rows = written(
            buckets.select("tree", "height", "bucket", _levels(F.col("base"), count).alias("levels")), "band"
        )
        found.append(rows)
        base = rows.select("tree", "height", F.inline(F.element_at("levels", -1)))
        roots = roots.unionByName(
            base.filter(F.col("height") <= start + BAND).select("tree", F.col("digest").alias("root"))
        )
        base = base.filter(F.col("height") > start + BAND)
    return Bands(found, written(roots, "roots"))


def with_paths(leaves: DataFrame, above: Bands) -> DataFrame:
    """``leaves`` with ``path``: the steps from each to the root of its tree."""

    def joined(nodes: DataFrame, rows: DataFrame, lo: str, hi: str, start: int) -> DataFrame:
        own = rows.select(
            F.col("tree").alias("_tree"), F.col("bucket").alias("_bucket"), "levels", "_above"
        )
        here = (F.col("tree") == F.col("_tree")) & (F.shiftright(lo, start + BAND) == F.col("_bucket"))
        none = F.array().cast(f"array<{STEP}>")
        steps = _steps(F.col("levels"), F.col(lo), F.col(hi), start)
        return nodes.join(own, here, "left").withColumn(
            "path", F.concat(steps, F.coalesce("_above", none))
        ).drop("_tree", "_bucket", "levels", "_above")

    upper = None
    for band in range(len(above.rows) - 1, -1, -1):
        rows = above.rows[band]
        if upper is None:
            rows = rows.withColumn("_above", F.lit(None).cast(f"array<{STEP}>"))
        else:
            # The root of a bucket is a base node of the next band.
            known = upper.select(
                F.col("tree").alias("_t"), F.shiftright("lo", (band + 1) * BAND).alias("_b"),
                F.col("path").alias("_above"),
            )
            rows = rows.join(known, (F.col("tree") == F.col("_t")) & (F.col("bucket") == F.col("_b")), "left")
        if band:
            nodes = above.rows[band - 1].filter(F.col("height") > band * BAND).select(
                "tree", F.inline(F.element_at("levels", -1))
            )
            upper = joined(nodes, rows, "lo", "hi", band * BAND).select("tree", "lo", "path")
        else:
            return joined(leaves, rows, "rank", "rank", 0)
    return leaves.withColumn("path", F.array().cast(f"array<{STEP}>"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(found: Column, step: Column) -> Column:
        other = F.coalesce(step["digest"], F.lit(""))
        return F.when(step["left"], digest(other, found)).otherwise(digest(found, other))

    return F.aggregate(path, start, up)


@dataclass
class Forest:
    """Ranked leaves, their trees, and the tree above the roots of these."""

    leaves: DataFrame
    trees: Bands
    tops: DataFrame
    last: Bands

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest) of all nodes above the leaves; the last tree's name is null."""
        schema = "tree string, level int, lo long, hi long, digest string"
        every = self.leaves.sparkSession.createDataFrame([], schema)
        for above, name in ((self.trees, F.col("tree")), (self.last, F.lit(None).cast("string"))):
            if above.rows:
                every = every.unionByName(above.nodes().withColumn("tree", name))
        return every

    def proofs(self) -> DataFrame:
        """The leaves with subroot, root and ``path``, the steps from each to the root."""
        upper = with_paths(self.tops, self.last).join(self.last.roots, "tree").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root",
            F.col("path").alias("_upper"),
        )
        return (
            with_group_values(with_paths(self.leaves, self.trees), upper, ["tree"])
            .withColumn("path", F.concat("path", "_upper"))
            .drop("_upper")
        )


def forest(leaves: DataFrame) -> Forest:
    """Trees over ``leaves`` (tree, doc_id, digest and others), in order of id, then digest."""
    rows = written(ranked(leaves, ["doc_id", "digest"]), "ranked")
    trees = bands(rows)
    tops = trees.roots.select(
        F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("digest")
    )
    tops = written(ranked(tops, ["name"]), "subroots")
    return Forest(rows, trees, tops, bands(tops))


def leaves_of(docs: DataFrame, *more: Column) -> DataFrame:
    """A leaf per document, with ``more`` columns."""
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf().alias("digest"), *more)


def manifest(docs: DataFrame) -> DataFrame:
    """(tree, level, lo, hi, digest) of all nodes above the leaves of ``docs``."""
    return forest(leaves_of(docs)).nodes()


def tampered_chars() -> Column:
    """One character more where 7 divides the checksum of the id."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.col("n_chars") + F.when(check % 7 == 0, 1).otherwise(0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaves = leaves_of(docs, leaf(n_chars=tampered_chars()).alias("tampered"))
    siblings = F.transform("path", lambda s: F.coalesce(s["digest"], F.lit("")))
    found = forest(leaves).proofs().withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql() -> str:
    """Every level of every tree by a recursive query; siblings by their number in the level."""

    def value(text: str) -> str:
        return f"coalesce(strlen(({text})::VARCHAR) || ':' || ({text})::VARCHAR, '-')"

    def leaf_of(chars: str) -> str:
        return "sha256(" + " || ".join(value(chars if f == "n_chars" else f) for f in FIELDS) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""
{name}(t, level, n, i, d) AS (
  SELECT t, 0, count(*) OVER (PARTITION BY t), i, d FROM {leaves}
  UNION ALL
  SELECT t, level + 1, (any_value(n) + 1) // 2, i // 2, sha256(string_agg(d, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY t, level, i // 2
)"""

    def ways(name: str, leaves: str, nodes: str) -> str:
        return f"""
{name} AS (
  SELECT l.t, l.i, coalesce(list(struct_pack(d := coalesce(s.d, ''), l := (l.i >> p.level) % 2 = 1)
      ORDER BY p.level) FILTER (WHERE p.n > 1), []) AS way
  FROM {leaves} l JOIN (SELECT DISTINCT t, level, n FROM {nodes}) p ON p.t = l.t
  LEFT JOIN {nodes} s ON s.t = l.t AND s.level = p.level AND s.i = xor(l.i >> p.level, 1)
  GROUP BY l.t, l.i
)"""

    bits = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"
    return f"""
WITH RECURSIVE sums AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), {bits}),
      lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS inverse
  FROM documents
),
docs AS (
  SELECT coalesce('+' || lang, '') AS t, doc_id, {leaf_of('n_chars')} AS d,
    {leaf_of("n_chars + CASE WHEN doc_id IS NOT NULL AND xor(inverse, 4294967295) % 7 = 0 THEN 1 ELSE 0 END")} AS changed
  FROM sums
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM docs
),
{levels('nodes', 'leaves').strip()},
subroots AS (
  SELECT '' AS t, t AS name, d, row_number() OVER (ORDER BY t) - 1 AS i FROM nodes WHERE n = 1
),
{levels('tops', 'subroots').strip()},
{ways('low', 'leaves', 'nodes').strip()},
{ways('high', 'subroots', 'tops').strip()},
found AS (
  SELECT doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, changed, low.way || high.way AS way
  FROM leaves l JOIN low USING (t, i) JOIN subroots s ON s.name = l.t
  JOIN high ON high.i = s.i, (SELECT d FROM tops WHERE n = 1) r
),
folds AS (
  SELECT *, list_reduce(list_prepend(struct_pack(d := changed, l := false), way),
    lambda a, b: struct_pack(d := sha256(CASE WHEN b.l THEN b.d || a.d ELSE a.d || b.d END), l := false)
  ).d AS folded_root
  FROM found
)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(way, lambda s: s.d), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folds
"""


QUERIES = {"op11_merkle": op11_merkle}
CHECKS = {"op11_merkle": _sql()}
