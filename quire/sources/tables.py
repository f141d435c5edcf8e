"""Readers for the input tables.

Every reader goes through ``spark.read.parquet`` so Catalyst can prune
columns and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Row keys used to spread a table whose files give too few input splits.
# Keys are unique per row, so the spread has no hot partition.
SPREAD_KEYS = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
    "benchmark": ["item_id"],
    "events": ["event_id"],
    "labels": ["doc_id"],
    "pages": ["page_id"],
}


def balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread a scan that yields fewer splits than there are cores.

    A Parquet file with one row group is read by one task, and everything
    narrow after it (regexes, tokenising, chunking) would run on one core.
    When the scan has fewer partitions than the default parallelism, hash
    it on the row key into ``spark.sql.shuffle.partitions`` parts; at scale
    (many files and row groups) this is a no-op.  Column pruning and filter
    pushdown still reach the scan below the exchange.
    """
    spark = df.sparkSession
    target = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(target, cores):
        return df
    return df.repartition(target, *keys)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread and name in SPREAD_KEYS:
        df = balanced(df, SPREAD_KEYS[name])
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
