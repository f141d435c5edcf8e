"""Exact, reproducible train/test splits; set operations; mini-batches.

The split orders rows by ``md5(seed:id)`` and puts the ``ceil(f * n)``
smallest hashes on the test side.  The cut hash is found by a distributed
selection: a histogram over hash prefixes (a few thousand counts reach the
driver), then the same on the one bucket that holds the cut, until the
bucket is small enough for a bounded ``orderBy().limit()``.  No global
window, no single-task sort of the whole table, and the result does not
depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 3  # hex digits per histogram level -> 4096 buckets
SMALL_BUCKET = 200_000  # rows a bounded top-k may handle in one task


def seeded_hash(id_col, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def n_test_rows(n: int, fraction: float) -> int:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be in (0, 1)")
    k = math.ceil(fraction * n)
    if n and (k <= 0 or k >= n):
        raise ValueError(f"split of {n} rows with fraction {fraction} leaves a side empty")
    return k


def kth_smallest(keys: DataFrame, key: str, k) -> tuple[str, int, int]:
    """The k-th smallest value of a unique string key (1-based).

    ``k`` may be a function of the row count; the first histogram level
    gives the count for free, so no separate ``count()`` pass is needed.
    Returns (value, k, n).
    """
    sub = keys.select(key)
    depth = 0
    rank = None
    n = None
    while True:
        depth += PREFIX
        bucket = F.substring(F.col(key), 1, depth)
        hist = sub.groupBy(bucket.alias("b")).count().orderBy("b").collect()
        if rank is None:
            n = sum(r["count"] for r in hist)
            rank = k(n) if callable(k) else k
            k = rank
        total = 0
        chosen = None
        for row in hist:
            if total + row["count"] >= rank:
                chosen = row
                break
            total += row["count"]
        if chosen is None:
            raise ValueError(f"only {total} keys, asked for number {rank}")
        rank -= total
        sub = sub.filter(F.substring(F.col(key), 1, depth) == chosen["b"])
        if chosen["count"] <= SMALL_BUCKET or depth >= 32:
            cut = sub.orderBy(key).limit(rank).agg(F.max(key).alias("m")).collect()[0]["m"]
            return cut, k, n


def exact_split(df: DataFrame, id_col: str, fraction: float, seed: int, side_col: str = "is_test") -> DataFrame:
    """Add ``side_col``: True for exactly ``ceil(fraction * n)`` rows.

    ``id_col`` must be unique; use ``grouped_split`` when copies share it.
    """
    keyed = df.withColumn("_h", seeded_hash(id_col, seed))
    cut, _, _ = kth_smallest(keyed, "_h", lambda n: n_test_rows(n, fraction))
    return keyed.withColumn(side_col, F.col("_h") <= F.lit(cut)).drop("_h")


def grouped_split(
    df: DataFrame, group_col: str, fraction: float, seed: int, side_col: str = "is_test"
) -> DataFrame:
    """Leak-free split: all rows of a group (a source document and its
    augmented copies) land on the same side; ``ceil(fraction * groups)``
    groups go to the test side."""
    groups = df.select(group_col).distinct().withColumn("_h", seeded_hash(group_col, seed))
    cut, _, _ = kth_smallest(groups, "_h", lambda n: n_test_rows(n, fraction))
    return df.withColumn(side_col, seeded_hash(group_col, seed) <= F.lit(cut))


def complement(all_rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``all_rows`` whose key is not in ``taken`` (anti join)."""
    return all_rows.join(taken.select(key), key, "left_anti")


def hash_shard(id_col, seed: int, n_shards: int) -> Column:
    """Deterministic shard in [0, n_shards) from the seeded md5."""
    return F.pmod(F.conv(F.substring(seeded_hash(id_col, seed), 1, 8), 16, 10).cast("bigint"), F.lit(n_shards))


def minibatches(
    df: DataFrame, id_col: str, batch_size: int, seed: int, n_shards: int, shuffle: bool = True
) -> DataFrame:
    """Batches of ``batch_size`` rows inside hash shards.

    Shuffled: rows ordered by the seeded hash within the shard; in order:
    by ``id_col``.  The position inside a shard is a blocked row number
    (blocks = hash prefixes), so a shard is never numbered by one task.
    """
    from quire.operators.aggregate import blocked_row_number

    h = seeded_hash(id_col, seed)
    if shuffle:
        block, order = F.substring(F.col("_h"), 1, PREFIX), [F.col("_h"), F.col(id_col)]
    else:
        block, order = F.floor(F.col(id_col) / F.lit(1 << 16)), [F.col(id_col)]
    d = df.withColumn("shard", hash_shard(id_col, seed, n_shards)).withColumn("_h", h)
    d = blocked_row_number(d, ["shard"], block, order, "_rn")
    rn = F.col("_rn") - 1
    return (
        d.withColumn("batch_no", F.floor(rn / batch_size).cast("bigint"))
        .withColumn("pos_in_batch", F.pmod(rn, F.lit(batch_size)).cast("bigint"))
        .drop("_rn", "_h")
    )
