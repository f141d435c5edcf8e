"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, held_out


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    chars: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most ``rows`` labelled training rows as (id, text, y), y in {0, 1}.

    Held-out rows, null labels and labels other than 0 and 1 take no part.
    The rows with the smallest hash of their id are chosen among the labels
    that have a document, so the choice does not depend on the order or the
    partitions of the tables.  Texts over ``chars`` characters are not used
    for fitting, and a repeated id counts once (its greatest text hash, its
    greatest label).  The result is bounded by ``rows`` x ``chars``.
    """
    ids = docs.where(F.length(col(text_col)) <= chars).select(col(id_col).alias("id")).distinct()
    chosen = (
        labels.select(col(id_col).alias("id"), col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .join(ids, "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    found = texts.where(F.length("text") <= chars).join(F.broadcast(chosen), "id")  # at most `rows` small rows
    return found.groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("id", "text", "y")
