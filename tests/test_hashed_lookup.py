"""Numbers of words that go to the tasks by their hashes: the same rows as the joins, without a shuffle."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import lookup as L
from quire.operators import rank as RK
from quire.operators import retrieve as RT
from quire.operators import segment as SG

DOCS = [(i % 7, f"Court {i} ruled on case {i % 3}. A river ran by. The law of {i % 5} held. - !") for i in range(30)] + [(None, ""), (8, None), (8, "- !")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_values_by_hash(spark):
    words = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", 1)], "word string, value int")
    held = L.hashed(words, 5)
    assert len(held.keys) == 2
    asked = spark.createDataFrame([(["d", "b", None, "a"],), ([],), (None,)], "w array<string>").select(L.hashes(F.col("w")).alias("h"))
    got = held.lists(asked.toArrow()["h"].combine_chunks())
    assert got.to_pylist() == [[1, 5, 0, 3], [], []]
    assert L.hashed(words.limit(0), 5).of(pa.array([7], pa.int64())).tolist() == [5]


def test_words_that_share_a_hash_are_joined(spark, monkeypatch):
    words = spark.createDataFrame([("a", 3), ("b", 5)], "word string, value int")
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert L.hashed(words, 5) is None


def test_outputs_are_ranked_where_the_rows_lie(spark, monkeypatch):
    rows = lambda df: sorted((str(r.doc_id), r.outputs, r.refs) for r in df.collect())
    out = RK.ranked_outputs(_docs(spark), size=8, overlap=2, budget=5, alone_col="refs")
    assert "Exchange" not in _plan(out) and "Join" not in _plan(out)
    monkeypatch.setattr(L, "HASHED", -1)
    joined = RK.ranked_outputs(_docs(spark), size=8, overlap=2, budget=5, alone_col="refs")
    assert "Join" in _plan(joined) and rows(out) == rows(joined)


def test_counts_and_rows_in_one_pass(spark):
    rows = spark.createDataFrame([(["a", "b"], 1), (["a"], 1), ([], 1), ([], 0), (None, 0)], "w array<string>, n int")
    counts, total = L.counted(rows, F.col("w"), F.col("n") > 0)
    assert total == 3 and {r.word: r.df for r in counts.collect()} == {"a": 2, "b": 1}


def test_passages_are_weighed_where_they_lie(spark, monkeypatch):
    p = _docs(spark).select("doc_id", F.split("text", " ").alias("tok")).unionAll(spark.createDataFrame([(9, ["court", None]), (9, [None])], "doc_id long, tok array<string>"))
    p = p.withColumn("no", F.monotonically_increasing_id())
    norms = lambda index: {r.no: r.n2 for r in index.vectors.collect() if r.n2}
    index = RT.build_index(p, "tok")
    plan = _plan(index.vectors)
    assert "Exchange" not in plan and "Join" not in plan
    found = norms(index)
    monkeypatch.setattr(L, "HASHED", -1)
    assert "n2" in RT.build_index(p, "tok").vectors.columns and norms(RT.build_index(p, "tok")) == found and found


@pytest.mark.parametrize("most", [2, 1 << 18])
def test_all_passages_are_not_shuffled_for_a_few(spark, monkeypatch, most):
    monkeypatch.setattr(RT, "NAMED", most)
    monkeypatch.setattr(L, "HASHED", 1 << 23)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _docs(spark).select("doc_id", F.split("text", " ").alias("tok"))
        q = spark.createDataFrame([(1, ["Court", "7"]), (2, ["river"])], "q int, tok array<string>")
        out = RT.search(RT.build_index(p, "tok"), q, "q", "tok", 3, ["doc_id"])
        assert ("BroadcastHashJoin" in _plan(out)) == (most > 2)
        assert out.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_are_cut_where_the_rows_lie(spark, monkeypatch):
    lexicon = spark.createDataFrame([("ab", 3), ("abc", 4), ("c", 2), ("cd", 2)], "word string, cost int")
    rows = [(1, ["abcd", "abcd", "xab"]), (1, []), (2, None), (3, [""])]
    df = spark.createDataFrame(rows, "id int, runs array<string>")
    out = SG.segment_df(df, "runs", lexicon, "words", 9)
    assert "Exchange" not in _plan(out) and "Join" not in _plan(out)
    got = sorted((r.id, str(r.words)) for r in out.collect())
    monkeypatch.setattr(SG, "SMALL_WORDS", 0)
    monkeypatch.setattr(L, "SMALL_WORDS", 0)
    joined = SG.segment_df(df, "runs", lexicon, "words", 9)
    assert "Join" in _plan(joined) and sorted((r.id, str(r.words)) for r in joined.collect()) == got
