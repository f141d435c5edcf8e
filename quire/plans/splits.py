"""Queries: exact seeded splits, grouped split, complement, mini-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import split as S
from quire.plans.cleaning import augmented
from quire.plans.registry import query
from quire.sources.tables import documents


@query(
    "split_exact",
    sql="""
SELECT doc_id, CASE WHEN rn <= (SELECT ceil(0.1 * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS side
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('66:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents)
""",
)
def split_exact(spark, sf_dir):
    """Exactly ceil(0.1 n) documents on the test side, seed 66."""
    d = documents(spark, sf_dir).select("doc_id")
    s = S.exact_split(d, "doc_id", 0.1, 66)
    return s.select("doc_id", F.when(F.col("is_test"), "test").otherwise("train").alias("side"))


@query(
    "split_grouped",
    sql="""
WITH a AS (SELECT doc_id, false AS is_augmented FROM documents UNION ALL SELECT doc_id, true FROM documents),
g AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn
      FROM (SELECT DISTINCT doc_id FROM a))
SELECT a.doc_id, a.is_augmented,
  CASE WHEN g.rn <= (SELECT ceil(0.2 * count(DISTINCT doc_id)) FROM a) THEN 'test' ELSE 'train' END AS side
FROM a JOIN g USING (doc_id)
""",
)
def split_grouped(spark, sf_dir):
    """Augmented copies follow their source document (no leakage), f=0.2 seed 42."""
    a = augmented(spark, sf_dir).select("doc_id", "is_augmented")
    s = S.grouped_split(a, "doc_id", 0.2, 42)
    return s.select("doc_id", "is_augmented", F.when(F.col("is_test"), "test").otherwise("train").alias("side"))


@query(
    "split_complement",
    sql="""
SELECT doc_id, lang FROM documents
WHERE doc_id NOT IN (
  SELECT doc_id FROM documents ORDER BY md5('66:' || CAST(doc_id AS VARCHAR))
  LIMIT (SELECT CAST(ceil(0.1 * count(*)) AS BIGINT) FROM documents))
""",
)
def split_complement(spark, sf_dir):
    """H2: train side = all documents minus the test side (anti join on id)."""
    d = documents(spark, sf_dir).select("doc_id", "lang")
    test = S.exact_split(d.select("doc_id"), "doc_id", 0.1, 66).filter("is_test")
    return S.complement(d, test, "doc_id")


@query(
    "minibatches",
    sql="""
WITH s AS (
  SELECT doc_id,
    CAST(('0x' || substr(md5('3407:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 8 AS BIGINT) AS shard,
    md5('3407:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
r AS (SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS rn FROM s)
SELECT doc_id, shard, CAST(floor(rn / 4) AS BIGINT) AS batch_no, CAST(rn % 4 AS BIGINT) AS pos_in_batch FROM r
""",
)
def minibatches(spark, sf_dir):
    """Shuffled mini-batches of 4 inside 8 hash shards."""
    d = documents(spark, sf_dir).select("doc_id")
    return S.minibatches(d, "doc_id", 4, 3407, 8).select("doc_id", "shard", "batch_no", "pos_in_batch")
