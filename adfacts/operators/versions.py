"""What differs between two versions of a table, found by a tree of bucket hashes.

Rows are hashed to buckets by their key. Both versions are summed up per bucket (rows, and two sums of
row hashes of 64 bits), which combines before the shuffle; only buckets whose sums differ are opened, to
``FANOUT`` smaller ones each, until they hold few rows. Rows of equal buckets never leave the scan; those
of the others are counted against each other, with their multiplicity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfacts.session import pinned

# Bits of a bucket's number that a level adds.
FANOUT_BITS = 10
LEVELS = 4
# Rows of a bucket that need no smaller ones.
SMALL = 64
# Differing buckets that are opened further; their list goes to all tasks.
OPENED = 1 << 16


def _summed(df: DataFrame, bucket: Column, side: str) -> DataFrame:
    """Rows and hashes of each bucket. Sums wrap nowhere: halves of hashes are added."""
    halves = {
        f"{side}{i}": F.sum(F.shiftright(F.col(h), 32) if up else F.col(h).bitwiseAND(0xFFFFFFFF))
        for i, (h, up) in enumerate((h, up) for h in ("_h1", "_h2") for up in (True, False))
    }
    return df.groupBy(bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias(f"{side}n"), *[value.alias(name) for name, value in halves.items()]
    )


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    # A null and its place count, as the hash of a null is that of nothing.
    marked = [v for c in sorted(df.columns) for v in (F.col(c), F.col(c).isNull())]
    of_key = [v for k in keys for v in (F.col(k), F.col(k).isNull())]
    return df.withColumns({
        "_h1": F.xxhash64(F.lit(1), *marked),
        "_h2": F.xxhash64(F.lit(2), *reversed(marked)),
        "_place": F.xxhash64(F.lit(3), *of_key),
    })


def differing(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """Buckets that differ, and how many bits of the key's hash name one.

    Both tables have ``_h1``, ``_h2`` and ``_place``.
    """
    opened = None
    for level in range(1, levels + 1):
        bits = FANOUT_BITS * level
        bucket = F.shiftrightunsigned("_place", 64 - bits)
        parts = []
        for df, side in ((old, "o"), (new, "n")):
            if opened is not None:
                above = F.shiftrightunsigned("_place", 64 - bits + FANOUT_BITS)
                df = df.join(F.broadcast(opened), above == F.col("_bucket"), "left_semi")
            parts.append(_summed(df, bucket, side))
        both = parts[0].join(parts[1], "_bucket", "full")
        same = [F.col(f"o{c}").eqNullSafe(F.col(f"n{c}")) for c in ("n", "0", "1", "2", "3")]
        unlike = both.filter(~(same[0] & same[1] & same[2] & same[3] & same[4]))
        size = F.coalesce("on", F.lit(0)) + F.coalesce("nn", F.lit(0))
        found = pinned(unlike.select("_bucket", size.alias("_size")))
        n, rows = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
        opened = found.select("_bucket")
        if rows <= n * SMALL or n > OPENED:
            break
    return (F.broadcast(opened) if n <= OPENED else opened), bits


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of only one version: the columns, ``change`` and ``copies``, how many more there are.

    ``change`` is ``removed`` or ``added``, or ``changed_from`` and ``changed_to`` where a key has rows
    of both kinds. Columns are compared by name; a null equals a null.
    """
    columns = old.columns
    sides = _hashed(old, keys), _hashed(new.select(*columns), keys)
    opened, bits = differing(*sides)
    bucket = F.shiftrightunsigned("_place", 64 - bits)
    # Few buckets go to the rows; if more differ than that, most rows do.
    left, right = (
        df.join(opened, bucket == F.col("_bucket"), "left_semi").select(*columns, F.lit(n).alias("_n"))
        for df, n in zip(sides, (-1, 1))
    )
    net = (
        left.unionByName(right).groupBy(*columns).agg(F.sum("_n").alias("_net"))
        .filter(F.col("_net") != 0)
    )
    net = pinned(net)
    both = net.groupBy(*keys).agg(
        ((F.min("_net") < 0) & (F.max("_net") > 0)).alias("_both")
    ).filter("_both").withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    kind = (
        F.when(F.col("_both"), F.when(F.col("_net") < 0, "changed_from").otherwise("changed_to"))
        .when(F.col("_net") < 0, "removed").otherwise("added")
    )
    return net.join(both, match, "left").select(
        *columns, kind.alias("change"), F.abs("_net").cast("long").alias("copies")
    )
