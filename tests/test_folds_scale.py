"""Folds with a pluggable model: what they cost beside the model's calls."""

from pyspark.sql import functions as F

from quire.operators import rank as RK
from quire.operators import summarise as SM


# a function made in a function travels with the job
def _model():
    return lambda prompt: prompt.split("<DOCUMENT>\n", 1)[1].rsplit("\n</DOCUMENT>", 1)[0].replace("\n\n", "+")


def test_rolling_apply_streams_documents(spark):
    rows = [(k, i, f"{k}{i}") for k in (None, "b", "a") for i in range(7)]
    df = spark.createDataFrame(rows[::-1], "k string, i int, chunk string").repartition(5)
    out = SM.rolling_apply(df, "k", "i", "chunk", _model())
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no call per document
    got = {(r["k"], r["step"]): r["output"] for r in out.collect()}
    assert len(got) == 21
    for k in (None, "b", "a"):
        for i in range(7):
            assert got[k, i] == "+".join(f"{k}{j}" for j in range(i + 1))


def test_rolling_apply_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.range(9).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").cast("string").alias("chunk"))
        got = sorted((r["step"], r["output"]) for r in SM.rolling_apply(df, "k", "i", "chunk", _model()).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [(n, "+".join(map(str, range(n + 1)))) for n in range(9)]


def test_words_of_a_chunk_are_normalised_at_once(monkeypatch):
    calls = []
    normal = RK.normal
    monkeypatch.setattr(RK, "normal", lambda t: calls.append(t) or normal(t))
    words, codes = RK.numbered_words(["Ab,", "--", "ab", "ΟΔΟΣ.", "c_d", "ß"])
    assert (words, codes) == (["ab", "οδος", "c_d", "ß"], [0, -1, 0, 1, 2, 3])
    assert len(calls) == 1
    assert RK.numbered_words([]) == ([], [])
    assert RK.numbered_words(["..."]) == ([], [-1])
