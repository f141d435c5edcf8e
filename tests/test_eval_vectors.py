"""Splits, ROUGE, folds, vectors and streaming state."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import rouge as R
from quire.operators import split as S
from quire.operators import summarise as SM
from quire.operators import vector as V
from quire.streaming import jobs as J


def test_exact_split_sizes_disjoint_and_stable(spark):
    df = spark.range(0, 1037).withColumnRenamed("id", "doc_id")
    a = S.exact_split(df, "doc_id", 0.1, 66)
    test_ids = {r.doc_id for r in a.filter("is_test").collect()}
    assert len(test_ids) == math.ceil(0.1 * 1037)
    b = S.exact_split(df.repartition(13), "doc_id", 0.1, 66)
    assert {r.doc_id for r in b.filter("is_test").collect()} == test_ids
    assert a.count() == 1037


def test_exact_split_multi_level(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL_BUCKET", 1)  # force the refinement levels
    df = spark.range(0, 500).withColumnRenamed("id", "doc_id")
    ids = {r.doc_id for r in S.exact_split(df, "doc_id", 0.3, 1).filter("is_test").collect()}
    assert len(ids) == 150


def test_grouped_split_keeps_copies_together(spark):
    rows = [(i, flag) for i in range(200) for flag in (False, True)]
    df = spark.createDataFrame(rows, "doc_id long, aug boolean")
    s = S.grouped_split(df, "doc_id", 0.2, 42)
    sides = s.groupBy("doc_id").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count()
    assert sides == 0
    assert s.filter("is_test").select("doc_id").distinct().count() == 40


def test_rouge1_literal(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "c", "d"])], "k long, c array<string>, r array<string>")
    row = R.rouge_n_pairs(df, ["k"], "c", "r", (1,), alpha=0.0).first()
    assert row.match == 2
    assert row.precision == pytest.approx(2 / 3)
    assert row.recall == pytest.approx(1 / 2)
    assert row.fmeasure == pytest.approx(1 / 2)  # alpha 0: F equals recall


def _lcs_dp(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = m[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(m[i - 1][j], m[i][j - 1])
    return m[-1][-1]


def test_lcs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 40))]
        assert R.lcs_length(a, b) == _lcs_dp(a, b)


def test_rouge_l_udf(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a", "c", "d", "x"])], "k long, c array<string>, r array<string>")
    row = R.rouge_l_pairs(df, ["k"], "c", "r").first()
    assert row.match == 3


def test_run_ids_adjacent_equal(spark, monkeypatch):
    df = spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s2"), (4, "s1")], "pos long, s string")
    out = {r.pos: r.run_start for r in SM.run_ids(df, "pos", "s").collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


def test_run_ids_across_blocks(spark):
    vals = [None, None, "a", "a", "a", "b", "b", None, None, None, None, None, None, "c", "c", "a", "a", None]
    df = spark.createDataFrame(list(enumerate(vals)), "pos long, s string")
    want, start = {}, 0
    for i, v in enumerate(vals):
        if i > 0 and vals[i - 1] != v:
            start = i
        want[i] = start
    for blocks in (1, 3, 6, 40):
        assert {r.pos: r.run_start for r in SM.run_ids(df, "pos", "s", blocks=blocks).collect()} == want
    plan = SM.run_ids(df, "pos", "s", blocks=6)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Map(_Value):
    def __init__(self):
        self.value = {}

    def exists(self):
        return bool(self.value)

    def containsKey(self, k):
        return k in self.value

    def getValue(self, k):
        return self.value[k]

    def updateValue(self, k, v):
        self.value[k] = v

    def removeKey(self, k):
        del self.value[k]

    def clear(self):
        self.value = {}


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, key, value):
        return _Map()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def _fold(quiet_ms=None):
    fold = J.RollingFold(lambda prev, c: c if prev is None else prev + "|" + c, quiet_ms)
    fold.init(_Handle())

    def feed(*rows):
        pdf = pd.DataFrame(rows, columns=["doc_id", "chunk_no", "n_chunks", "chunk"])
        return pd.concat(fold.handleInputRows((rows[0][0],), iter([pdf]), _Clock()))["output"].tolist()

    return fold, feed


def test_stream_state_buffers_out_of_order_chunks():
    fold, feed = _fold()
    assert feed((7, 1, 3, "b")) == [] and fold.waiting.value == {(1,): ("b",)}
    assert feed((7, 0, 3, "a"), (7, 2, 3, "c")) == ["a", "a|b", "a|b|c"]
    # of a finished document only the counts stay, so that repeats are known
    assert not fold.waiting.exists() and not fold.last.exists() and fold.next.value == (3, 3)
    assert feed((7, 0, 3, "a"), (7, 2, 3, "c")) == [] and not fold.waiting.exists()


def test_topk_against_brute_force_with_ties(spark):
    rnd = np.random.default_rng(0)
    corpus = rnd.integers(0, 3, size=(60, 8)).astype(float)
    corpus[10] = corpus[11]  # an exact tie: the smaller id wins
    queries = rnd.integers(0, 3, size=(7, 8)).astype(float)
    queries[0] = corpus[10]
    cdf = spark.createDataFrame([(i, corpus[i].tolist()) for i in range(60)], "doc_id long, v array<double>").repartition(4)
    qdf = spark.createDataFrame([(100 + i, queries[i].tolist()) for i in range(7)], "qid long, v array<double>")
    got = V.topk_cosine(qdf, "qid", "v", cdf, "doc_id", "v", 3, 8).collect()
    got = {(r.query_id, r.rank): r.cand_id for r in got}
    for qi in range(7):
        q = queries[qi]
        scores = []
        for i in range(60):
            n = np.linalg.norm(q) * np.linalg.norm(corpus[i])
            if n > 0:
                scores.append((-(q @ corpus[i]) / n, i))
        scores.sort()
        for rank, (_, i) in enumerate(scores[:3], start=1):
            assert got[(100 + qi, rank)] == i


def test_topk_plan_has_no_pair_join(spark):
    cdf = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "doc_id long, v array<double>")
    plan = V.topk_cosine(cdf, "doc_id", "v", cdf, "doc_id", "v", 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_upsert_same_id_twice_last_wins(spark):
    base = spark.createDataFrame([(1, "old", 0), (2, "keep", 0)], "id long, v string, version int")
    delta = spark.createDataFrame([(1, "new1", 1), (1, "new2", 2), (3, "ins", 1)], "id long, v string, version int")
    out = {r.id: r.v for r in V.upsert(base, delta, "id", "version").collect()}
    assert out == {1: "new2", 2: "keep", 3: "ins"}


def test_dimension_check(spark):
    df = spark.createDataFrame([([0.0] * 64,), ([0.0] * 63,), (None,)], "v array<double>")
    bad = df.filter(V.dimension_check(df, "v", 64)).count()
    assert bad == 2


def test_collection_exact_name(spark):
    assert V.ensure_collection(spark, "x_c", 64) is True
    assert V.ensure_collection(spark, "x_c", 64) is False
    assert not spark.catalog.tableExists("c")


def test_upsert_without_versions_and_with_older_ones(spark):
    schema = "id string, v string, version int"
    base = spark.createDataFrame([("a", "base5", 5), ("b", "base", 1), ("b", "base", 1)], schema)
    delta = spark.createDataFrame([("a", "old2", 2), ("c", "x", 1), ("c", "y", 1)], schema)
    got = V.upsert(base, delta, "id", "version").collect()
    assert sorted(r.id for r in got) == ["a", "b", "c"] and {r.id: r.v for r in got}["a"] == "base5"
    assert {r.id: r.v for r in V.upsert(base, delta, "id").collect()}["a"] == "old2"


def test_batches_replay_and_older_versions(spark, tmp_path):
    schema, root = "id long, v string, version int", str(tmp_path / "coll")
    put = lambda rows, i: J.write_batch(spark.createDataFrame(rows, schema), root, i)
    put([(1, "a", 0), (3, "z", 7)], -1)
    put([(1, "b", 1), (2, "c", 1), (3, "older", 2)], 0)
    put([(1, "b", 1), (2, "c", 1), (3, "older", 2)], 0)  # replayed
    put([(2, "d", 1), (2, "d", 1)], 1)
    got = J.current_points(spark, root, schema, "id", "version").collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "b"), (2, "d"), (3, "z")]


def test_dimension_is_enforced_on_write(spark):
    schema = "id string, vector array<float>, payload struct<page_content:string,metadata:map<string,string>>"
    V.ensure_collection(spark, "x_dim", 2)
    V.append_points(spark, "x_dim", spark.createDataFrame([("a", [1.0, 2.0], None), ("b", None, None)], schema))
    with pytest.raises(Exception, match="expected 2 components"):
        V.append_points(spark, "x_dim", spark.createDataFrame([("c", [1.0], None)], schema))
    assert spark.table("x_dim").count() == 2


def test_streams_read_folders_of_part_files(spark, tmp_path):
    import __spark_entry__ as E
    from quire.sources.tables import TABLES
    from tests.conftest import SF_SMALL

    for t in TABLES:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(4).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = lambda name, d: sorted(map(str, E.queries()[name](spark, d).collect()))
    assert rows("stream_chunks", str(tmp_path)) == rows("token_windows", SF_SMALL)


def test_rolling_state_ignores_repeats_and_reports_the_missing():
    fold, feed = _fold(50)
    assert feed((1, 0, 2, "a")) == ["a"] and feed((1, 0, 2, "a")) == [] and feed((1, 1, 2, "b")) == ["a|b"]
    assert fold.handle.timers == [1050]  # one timer, moved by every chunk
    assert pd.concat(fold.handleExpiredTimer((1,), None, None)).empty
    assert not (fold.next.exists() or fold.last.exists() or fold.waiting.exists())
    feed((1, 1, 3, "late"))
    out = pd.concat(fold.handleExpiredTimer((1,), None, None))
    assert out.to_dict("records") == [{"doc_id": 1, "step": 0, "output": None}] and not fold.waiting.exists()


def test_rolling_stream_out_of_order_micro_batches(spark, tmp_path):
    import os
    import time

    src = tmp_path / "chunks"
    src.mkdir()
    schema = "doc_id long, chunk_no int, n_chunks int, chunk string"
    # micro-batch 1 carries chunk 1 of doc 7 (and all of doc 8); batch 2 brings chunk 0 of doc 7
    first = spark.createDataFrame([(7, 1, 2, "b b"), (8, 0, 1, "x")], schema)
    second = spark.createDataFrame([(7, 0, 2, "a a")], schema)
    first.coalesce(1).write.parquet(str(src / "p1"))
    time.sleep(1.1)
    second.coalesce(1).write.parquet(str(src / "p2"))
    files = sorted(str(p) for p in src.rglob("*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):  # one file per micro-batch, in this order
        os.link(f, flat / f"part-{i}.parquet")
        os.utime(flat / f"part-{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    out = J.rolling_stream(stream, lambda prev, c: c if prev is None else prev + "|" + c)
    with J.rocksdb_state(spark):
        path = J.run_available(out, "test-rolling")
    rows = sorted((r.doc_id, r.step, r.output) for r in spark.read.parquet(path).collect())
    assert rows == [(7, 0, "a a"), (7, 1, "a a|b b"), (8, 0, "x")]


def test_topk_payload_rides_along(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)], f"doc{i}") for i in range(40)]
    cdf = spark.createDataFrame(rows, "doc_id long, v array<double>, summary string").repartition(3)
    qdf = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [4.0, 1.0, 2.0])], "qid long, v array<double>")
    got = V.topk_cosine(qdf, "qid", "v", cdf, "doc_id", "v", 4, 3, payload=["summary"]).collect()
    assert len(got) == 8
    assert all(r.summary == f"doc{r.cand_id}" for r in got)
    plain = {(r.query_id, r.rank): r.cand_id for r in V.topk_cosine(qdf, "qid", "v", cdf, "doc_id", "v", 4, 3).collect()}
    assert plain == {(r.query_id, r.rank): r.cand_id for r in got}
