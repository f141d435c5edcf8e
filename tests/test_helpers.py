"""Helpers behind the scale fixes: spread reads, outer explode, blocked
row numbers, ordered concatenation, taps, strict drops."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.text import bind, explode_rows, ws_tokens
from quire.operators import aggregate as A
from quire.operators import clean as K
from quire.sources import tables


def test_spread_only_when_too_few_splits(spark):
    one = spark.range(0, 100).coalesce(1)
    spread = tables.balanced(one, ["id"])
    assert spread.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range(0, 100).repartition(16)
    assert tables.balanced(many, ["id"]).rdd.getNumPartitions() == 16


def test_explode_rows_matches_posexplode_and_infers_no_filter(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "d")], "id long, t string")
    arr = ws_tokens(F.col("t"))
    got = sorted(tuple(r) for r in explode_rows(df, arr, ["id"], ("pos", "tok")).collect())
    want = sorted(tuple(r) for r in df.select("id", F.posexplode(arr).alias("pos", "tok")).collect())
    assert got == want
    plan = explode_rows(df, arr, ["id"], ("pos", "tok"))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Generate")[1]  # nothing pushed under the generator


def test_bind_evaluates_once(spark):
    df = spark.createDataFrame([("x y z",)], "t string")
    out = df.select(bind(ws_tokens(F.col("t")), lambda tok: F.transform(tok, lambda _x, i: F.slice(tok, 1, i + 1)))).first()[0]
    assert out == [["x"], ["x", "y"], ["x", "y", "z"]]


def test_blocked_row_number_equals_window(spark):
    rows = [(k, t) for k in range(3) for t in range(0, 200, 3)] + [(9, t) for t in range(1000)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = A.blocked_row_number(df, ["k"], F.floor(F.col("t") / 7), [F.col("t")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordered_concat_two_levels(spark):
    rows = [(1, i, f"w{i}") for i in range(50)] + [(2, 0, "only"), (3, 0, None)]
    df = spark.createDataFrame(rows, "k long, pos long, t string")
    out = {r.k: r.s for r in A.ordered_concat(df, "k", "pos", "t", " ", "s", block=7).collect()}
    assert out[1] == " ".join(f"w{i}" for i in range(50))
    assert out[2] == "only"
    assert out[3] is None  # all texts null: a null result, as string_agg gives


def test_tap_is_pass_through(spark):
    df = spark.range(0, 10)
    tapped = A.tap(df, "t1", F.count(F.lit(1)).alias("n"))
    assert tapped.count() == 10


def test_drop_columns_strict(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert K.drop_columns_strict(df, "a").columns == ["b"]
    with pytest.raises(KeyError):
        K.drop_columns_strict(df, "Unnamed: 0")


def test_content_id_is_deterministic(spark):
    df = spark.createDataFrame([("x", None), ("x", None)], "a string, b string")
    ids = {r[0] for r in df.select(K.content_id("a", "b")).collect()}
    assert len(ids) == 1


def test_read_nested_results(spark, tmp_path):
    import json

    from quire.sources.io import read_nested_results

    p = tmp_path / "results.json"
    p.write_text(json.dumps([["s0", "s1"], [], ["t0"]], ensure_ascii=False))
    rows = sorted((r.doc_pos, r.step, r.output) for r in read_nested_results(spark, str(p)).collect())
    assert rows == [(0, 0, "s0"), (0, 1, "s1"), (2, 0, "t0")]


def test_a_written_table_can_be_dropped(spark, tmp_path):
    import os

    from quire.session import cut_lineage, drop_written

    df = cut_lineage(spark.range(5), "gone")
    files = [f.split("file:", 1)[-1].lstrip("/") for f in df.inputFiles()]
    assert files and all(os.path.exists("/" + f) for f in files)
    drop_written(df)
    assert not any(os.path.exists("/" + f) for f in files)
    spark.range(3).write.parquet(f"{tmp_path}/kept")
    drop_written(spark.read.parquet(f"{tmp_path}/kept"))  # not one of ours
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3
