"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, fresh
from quire.session import cut_lineage


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    The rows are range-partitioned by (group, order), so a hot group is cut
    into many partitions; each partition sums its own rows and gets the total
    of the group's earlier partitions added.  The table of totals has at most
    one row per partition and group, and groups share a partition only at
    their edges.  The partitioned rows are written to the shared folder once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, before = fresh(df, "_part"), fresh(df, "_before")
    keys = [col(c) for c in (*group, *order)]
    rows = cut_lineage(df.repartitionByRange(parts, *keys).withColumn(part, F.spark_partition_id()), "ranged")
    totals = rows.groupBy(*map(col, group), part).agg(F.sum(col(value)).alias("total"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[col(g).alias(f"g{i}") for i, g in enumerate(group)],
        F.col(part).alias("p"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias(before),
    )
    same = [col(g).eqNullSafe(F.col(f"g{i}")) for i, g in enumerate(group)]
    inside = Window.partitionBy(*map(col, group), col(part)).orderBy(*map(col, order)).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(out, F.coalesce(F.sum(col(value)).over(inside), F.lit(0)))
    joined = local.join(totals, [col(part) == F.col("p"), *same])
    return joined.withColumn(out, col(out) + col(before)).drop("p", before, part, *[f"g{i}" for i in range(len(group))])
