"""The corpus pipeline: documents in, a clean training mix out.

Each stage takes what its predecessor kept and calls one operator of
``quire.llm``; between stages the rows are written to the shared folder as
Parquet, so a lost executor never costs more than the running stage.

1. quality classifier: documents below the threshold go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: documents that hold a test item go;
4. PII: personal data is replaced by surrogates;
5. mixing sources to target weights: documents of which the mix takes no
   word go; ``mix_copies`` and ``mix_words`` say how much it takes of the rest.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, pii, quality, simhash
from quire.llm.common import read
from quire.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, pii.secret_key(spark))
    if "n_chars" in docs.columns:  # the length of the text as it now is
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

# Fitted models, hashes and drawn surrogates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
