"""Ordered and skew-safe aggregation helpers.

``ordered_concat`` joins the strings of a group in a given order.  It runs
in two levels: first per (key, block of the order column), then per key
over the block results, so a hot key (a very long conversation, a run that
spans many documents) is split over many tasks before the final merge,
and each level is pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

BLOCK = 1024


def _join_sorted(order_field: str, value_field: str, sep: str):
    return lambda arr: F.array_join(
        F.transform(F.array_sort(arr), lambda s: s[value_field]), sep
    )


def ordered_concat(
    df: DataFrame, key, order_col, text_col: str, sep: str, out_col: str, block: int = BLOCK,
    count_col: str | None = None, extras: dict | None = None,
) -> DataFrame:
    """``string_agg(text, sep ORDER BY order_cols)`` per key, in two levels.

    ``order_col`` is one column or a list; the first must be integral and
    the whole list unique within a key.  Level one groups by (key, block of
    the first order column).  ``extras`` maps an output name to a pair
    (level-one aggregate, level-two combine function), e.g.
    ``{"n": (F.count(F.lit(1)), F.sum)}``, for decomposable aggregates
    computed in the same pass.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order_col] if isinstance(order_col, str) else list(order_col)
    blk = F.floor(F.col(orders[0]) / block).alias("_blk")
    okey = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(orders)])
    extras = extras or {}
    lvl1 = df.groupBy(*keys, blk).agg(
        _join_sorted("o", "t", sep)(F.collect_list(F.struct(okey.alias("o"), F.col(text_col).alias("t")))).alias("_part"),
        F.count(F.col(text_col)).alias("_n"),
        *[first.alias(f"_x_{name}") for name, (first, _) in extras.items()],
    )
    # like string_agg: null texts are skipped (a block of only nulls gives a
    # null part, which array_join skips with its separator), and a key whose
    # texts are all null gets a null result
    lvl1 = lvl1.withColumn("_part", F.when(F.col("_n") > 0, F.col("_part")))
    joined = _join_sorted("b", "p", sep)(F.collect_list(F.struct(F.col("_blk").alias("b"), F.col("_part").alias("p"))))
    out = [F.when(F.sum("_n") > 0, joined).alias(out_col)]
    if count_col:
        out.append(F.sum("_n").alias(count_col))  # number of non-null texts
    out += [combine(f"_x_{name}").alias(name) for name, (_, combine) in extras.items()]
    return lvl1.groupBy(*keys).agg(*out)


def tap(df: DataFrame, name: str, *metrics) -> DataFrame:
    """Pass-through with named metrics gathered while the data flows
    (``DataFrame.observe``): no extra pass over the data."""
    return df.observe(name, *metrics) if metrics else df



def blocked_row_number(df: DataFrame, keys: list[str], block, order: list, out_col: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without
    putting a hot key in one task.

    ``block`` must be non-decreasing along ``order`` within a key (a prefix
    of a hash, ``floor(position / B)``).  Rows are numbered inside each
    (key, block) window; each block's offset is a running sum over the
    per-block counts, a table with one row per block.
    """
    from pyspark.sql import Window

    d = df.withColumn("_b", block)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(w))
    cnt = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).drop("_c")
    return d.join(cnt, [*keys, "_b"]).withColumn(out_col, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def in_order(df: DataFrame, order_col: str, out_col: str = "pos") -> DataFrame:
    """Adds each row's place (from 0) along ``order_col``, which must be unique.

    Rows are dealt to ranges of the order and written once; a range's offset
    comes from a table of one row per range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, order_col).withColumn("_part", F.spark_partition_id()), "ranged")
    out = blocked_row_number(ranged, [], F.col("_part"), [F.col(order_col)], out_col)
    return out.withColumn(out_col, (F.col(out_col) - 1).cast("long")).drop("_part")
