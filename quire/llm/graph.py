"""Connected components of an undirected graph, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
every round links each node's neighbours to the smallest of them.  A
round is one map-side combined minimum and one equi-join; the edge table
never grows, and it is written to the shared folder between rounds, so a
lost executor costs one round at most.  Only a row count and a checksum
of the table come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on ``edges(u, v)`` with u > v, each pair once."""
    if large:  # every node sees all its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # every node sees its smaller neighbours
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node
    reachable.  Loops, repeated edges and both directions are fine; null ends
    are dropped; an empty table gives an empty result."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    table = cut_lineage(
        edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .where(x.isNotNull() & y.isNotNull() & (x != y))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())

    seen = mark(table)
    while seen[0]:
        table = cut_lineage(_star(_star(table, True), False), "edges")
        now = mark(table)
        if now == seen:
            break
        seen = now
    roots = table.select(F.col("v").alias("node")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
