"""Lexicon tables: small ones meet the tokens where they lie, with the same rows as the join."""

import pytest
from pyspark.sql import functions as F

from quire.operators import clean as K
from quire.operators import lookup as L

ROWS = [(1, ["the", "cat", "the", None]), (1, ["cat"]), (None, []), (2, None), (3, ["and"])]


@pytest.mark.parametrize("most", [0, 50_000])
def test_small_and_large_lexicons_agree(spark, monkeypatch, most):
    monkeypatch.setattr(L, "SMALL_WORDS", most)
    df = spark.createDataFrame(ROWS, "id int, tok array<string>").repartition(3)
    stop = spark.createDataFrame([("the",), ("the",), (None,), ("and",)], "word string")
    out = K.remove_stop_words_df(df, "id", "tok", stop, "kept")
    got = sorted((str(r.id), str(r.kept)) for r in out.collect())
    assert got == sorted([("1", "['cat', None]"), ("1", "['cat']"), ("None", "[]"), ("2", "None"), ("3", "[]")])
    names = spark.createDataFrame([("the", "a"), ("cat", "dog"), ("cat", "ape"), ("and", None)], "word string, synonym string")
    out = K.replace_synonyms_df(df, "id", "tok", names, "out")
    got = sorted((str(r.id), str(r.out)) for r in out.collect())
    assert got == sorted([("1", "['a', 'ape', 'a', None]"), ("1", "['ape']"), ("None", "[]"), ("2", "None"), ("3", "['and']")])


def test_a_small_lexicon_shuffles_no_tokens(spark):
    df = spark.range(40).select("id", F.array(F.lit("the"), F.col("id").cast("string")).alias("tok"))
    out = K.remove_stop_words_df(df, "id", "tok", spark.createDataFrame([("the",)], "word string"), "kept")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.kept[0] for r in out.collect()} == {str(i) for i in range(40)}


@pytest.mark.parametrize("most", [0, 50_000])
def test_runs_are_cut_alike_by_small_and_large_lexicons(spark, monkeypatch, most):
    from quire.operators import segment as SG

    monkeypatch.setattr(L, "SMALL_WORDS", most)
    lexicon = spark.createDataFrame([("ab", 3), ("abc", 4), ("c", 2), ("cd", 2), ("é", 1)], "word string, cost int")
    words = spark.createDataFrame([("abcd",), ("xaby",), ("ééc",), ("zzz",)], "word string")
    out = SG.segmented(words, lexicon, 9, 3)
    assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)
    assert {r.word: r.value for r in out.collect()} == {
        "abcd": ["ab", "cd"], "xaby": ["x", "ab", "y"], "ééc": ["é", "é", "c"], "zzz": ["z", "z", "z"]
    }
