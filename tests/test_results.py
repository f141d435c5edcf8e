"""Positional results, a caller's splitter, places along an order."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import chunk as C
from quire.operators.aggregate import in_order
from quire.operators.lookup import as_lists
from quire.sources import io as IO


def test_places_along_an_order(spark):
    df = spark.range(1000).selectExpr("1000 - id AS k", "id").repartition(7)
    got = sorted((r.k, r.pos) for r in in_order(df, "k").collect())
    assert got == [(i + 1, i) for i in range(1000)]
    assert in_order(df.limit(0), "k").collect() == []


@pytest.mark.parametrize("per_file", [1, 7, 1000])
def test_positional_round_trip(spark, tmp_path, per_file):
    rows = [(i * 3, [f"s{i}_{j}\n\"q\" é" for j in range(i % 4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, steps array<string>").repartition(3)
    path = f"{tmp_path}/r"
    IO.write_positional(df, "id", "steps", path, per_file)
    back = IO.read_positional(spark, path)
    assert sorted((r.pos, r.steps) for r in back.collect()) == [(i, s) for i, (_, s) in enumerate(rows)]
    ids = df.select("id")
    assert sorted((r.id, r.steps) for r in IO.attach_positional(ids, "id", back).collect()) == rows


def test_length_mismatch_fails(spark, tmp_path):
    df = spark.createDataFrame([(i, ["x"]) for i in range(5)], "id long, steps array<string>")
    IO.write_positional(df, "id", "steps", f"{tmp_path}/r", 2)
    back = IO.read_positional(spark, f"{tmp_path}/r")
    more, fewer = spark.range(6), spark.range(4)
    for ids, message in ((more, "no result for row 5"), (fewer, "no row for result 4")):
        with pytest.raises(Exception, match=message):
            IO.attach_positional(ids, "id", back).collect()


def test_results_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def steps(i):
        made.add(1)
        return [f"s{i}"]

    df = spark.range(40).select("id", steps.asNondeterministic()("id").alias("steps"))
    IO.write_positional(df, "id", "steps", f"{tmp_path}/r", 7)
    assert made.value == 40
    assert sorted((r.pos, r.steps) for r in IO.read_positional(spark, f"{tmp_path}/r").collect()) == [(i, [f"s{i}"]) for i in range(40)]


@pytest.mark.parametrize("kind", [pa.string(), pa.int32()])
def test_lists_of_a_slice(kind):
    rows = [[1, 2], None, [], [3, None], [4]]
    rows = [r and [v if v is None or kind == pa.int32() else str(v) for v in r] for r in rows]
    array = pa.array(rows, pa.list_(kind))
    for a, b in ((0, 5), (1, 4), (0, 3), (4, 5), (2, 2)):
        got = as_lists(array.slice(a, b - a))
        assert got == [r or [] for r in rows[a:b]]
        assert all(type(v) in (int, str, type(None)) for r in got for v in r)


def test_callers_splitter(spark):
    df = spark.createDataFrame([(1, "a;b;c"), (1, "d"), (2, None), (3, "")], "id int, text string").withColumn("chunk_", F.lit(1))
    got = C.split_rows(df, "text", lambda t: [x for x in t.split(";") if x], ["id"])
    assert got.columns == ["id", "chunk_no", "chunk"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 0, "d"), (1, 1, "b"), (1, 2, "c")]
    assert C.split_rows(df.limit(0), "text", str.split, ["id"]).collect() == []
