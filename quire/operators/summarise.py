"""Folding chunk outputs back to one result per document.

* ``rolling_apply``: the carry-forward fold (step i sees the output of step
  i-1) with a pluggable model.  A document's chunks lie in one partition, in
  order, and stream through Arrow batches: a task holds one batch and the
  previous output, and no document costs a call of its own.
  The built-in extractive model folds inside the row, see ``operators.rank``.
* ``map_outputs`` + ``ordered_concat``: each chunk on its own, then joined
  in chunk order.
* ``run_ids``: runs of consecutive equal keys over a global order (the
  positional grouping of the original), computed with blocked windows: a
  window per range block plus a small per-block carry table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases that mark an output declining to summarise.
REFUSAL_PHRASES = [
    "無法根據所提供的文章",
    "無法提供",
    "I'm sorry",
    "I cannot",
    "I can't",
    "I don't know the answer",
]


def rolling_apply(
    chunk_rows: DataFrame, key: str, order_col: str, chunk_col: str, fn: Callable[[str], str]
) -> DataFrame:
    """Carry-forward fold with a pluggable model ``fn(prompt) -> text``.

    Output rows: (key, step, prompt, output).  The first step's prompt holds
    the chunk; later prompts hold the previous output, a blank line and the
    chunk (the templates of ``quire.operators.prompt``).
    """
    from quire.operators.prompt import FOLLOW_PROMPT, INIT_PROMPT

    key_type = chunk_rows.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, step int, prompt string, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, step, prev = None, -1, None
        for batch in batches:
            keys, _, chunks = batch.columns
            steps, prompts, outputs = [], [], []
            for k, chunk in zip(keys.to_pylist(), chunks.to_pylist()):
                first = step < 0 or k != before
                before, step = k, 0 if first else step + 1
                prompt = INIT_PROMPT.format(document=chunk) if first or prev is None else FOLLOW_PROMPT.format(summary=prev, document=chunk)
                prev = fn(prompt)
                steps.append(step)
                prompts.append(prompt)
                outputs.append(prev)
            cols = [keys, pa.array(steps, pa.int32()), pa.array(prompts, pa.string()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [key, "step", "prompt", "output"])

    rows = chunk_rows.select(key, order_col, chunk_col)
    return rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order_col), chunk_col).mapInArrow(run, schema)


def map_outputs(texts: Column, fn: Callable[[list], list]) -> Column:
    """Each chunk summarised on its own by a batched model hook."""

    @F.pandas_udf(T.StringType())
    def _run(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.tolist()), dtype=object)

    return _run(texts)


def last_output(steps: Column) -> Column:
    """Final output of a fold (null when there were no chunks)."""
    return F.try_element_at(steps, F.lit(-1))


def refusal_flag(text: Column, phrases=REFUSAL_PHRASES) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | text.contains(p)
    return F.coalesce(cond, F.lit(False))


def run_ids(df: DataFrame, order_col: str, value_col: str, blocks: int | None = None) -> DataFrame:
    """Number runs of consecutive equal ``value_col`` along ``order_col``: rows
    (order, value, ``run_start``), the order of the run's first row.

    The rows are range-partitioned once into ``blocks`` (the number of shuffle
    partitions by default) and written; windows stay inside a block.  What
    crosses an edge (the last value of the block before, and where its last
    run began) comes from a table with one row per block, joined on the block.
    Nulls are equal to each other, also across edges.
    """
    from quire.session import cut_lineage

    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = df.select(order_col, value_col).repartitionByRange(blocks, order_col)
    b = cut_lineage(b.withColumn("_blk", F.spark_partition_id()), "runs")
    w = Window.partitionBy("_blk").orderBy(order_col)
    over_blocks = Window.orderBy("_blk")  # one row per block
    edges = b.groupBy("_blk").agg(F.max_by(F.struct(value_col), order_col).alias("_last"))
    edges = edges.select("_blk", F.lag("_last").over(over_blocks).alias("_carry"))
    # a struct, so that "no row before" and "a null before" differ
    before = F.coalesce(F.lag(F.struct(value_col)).over(w), F.col("_carry"))
    b = b.join(edges, "_blk").withColumn("_before", before)
    start = F.col("_before").isNull() | ~F.col("_before")[value_col].eqNullSafe(F.col(value_col))
    b = b.withColumn("_at", F.when(start, F.col(order_col)))
    begun = b.groupBy("_blk").agg(F.max("_at").alias("_begun"))
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("_blk", F.max("_begun").over(earlier).alias("_earlier"))
    here = F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = b.join(begun, "_blk").withColumn("run_start", F.coalesce(here, F.col("_earlier")))
    return out.select(order_col, value_col, "run_start")
