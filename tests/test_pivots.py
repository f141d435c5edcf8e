"""Exact nearest neighbours through cells, against every pair."""

import math
import random

import pytest

from quire.operators import vector as V


def brute(queries, corpus, k, same=False):
    out = set()
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), c) for c, b in corpus if not (same and c == q))
        out |= {(q, r, c, round(-s, 7)) for r, (s, c) in enumerate(scored[:k], 1)}
    return out


def rows(df):
    return {(r.query_id, r["rank"], r.cand_id, round(r.score, 7)) for r in df.collect()}


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("block,pivots", [(4096, 16), (7, 5), (50, 1)])
def test_equals_all_pairs(spark, block, pivots):
    rnd = random.Random(block)
    corpus = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(220)]
    df = frame(spark, corpus)
    got = V.topk_cosine(df, "id", "v", df, "id", "v", 3, exclude_self=True, block=block, pivots=pivots)
    assert rows(got) == brute(corpus, corpus, 3, same=True)


def test_clusters_let_most_cells_be_skipped(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    corpus = [(i, [c + rnd.gauss(0, 0.02) for c in centres[i % 20]]) for i in range(600)]
    asked = [(i, [c + rnd.gauss(0, 0.02) for c in centres[i % 20]]) for i in range(40)]
    report = {}
    got = V.topk_cosine(frame(spark, asked), "id", "v", frame(spark, corpus), "id", "v", 4, pivots=60, report=report)
    assert rows(got) == brute(asked, corpus, 4)
    assert report["met"] < 0.25 * report["pairs"], report


def test_odd_vectors(spark):
    corpus = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [None, 1.0])]
    asked = [(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])]
    out = V.topk_cosine(frame(spark, asked), "id", "v", frame(spark, corpus), "id", "v", 9)
    got = sorted((r.query_id, r.cand_id) for r in out.collect())
    assert got == [(1, 1), (1, 2), (1, 7), (1, 7)]
    assert V.topk_cosine(frame(spark, asked), "id", "v", frame(spark, corpus).limit(0), "id", "v", 2).collect() == []
    assert V.topk_cosine(frame(spark, asked).limit(0), "id", "v", frame(spark, corpus), "id", "v", 2).collect() == []
    with pytest.raises(ValueError):
        V.topk_cosine(frame(spark, asked), "id", "v", frame(spark, corpus), "id", "v", 0)


def test_a_vector_is_not_sent_once_a_cell(spark, monkeypatch):
    rnd = random.Random(3)
    corpus = [(i, [rnd.gauss(0, 1) for _ in range(12)]) for i in range(400)]  # no clusters: hardly a cell can be skipped
    written, cut = {}, V.cut_lineage

    def counted(df, name="stage"):
        out = cut(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(V, "cut_lineage", counted)
    df, report = frame(spark, corpus), {}
    got = V.topk_cosine(df, "id", "v", df, "id", "v", 2, exclude_self=True, block=100, pivots=20, report=report)
    assert rows(got) == brute(corpus, corpus, 2, same=True)
    assert report["met"] > 0.5 * report["pairs"], report
    assert max(written.values()) <= len(corpus), written
    assert V._tiles(600_000, 600_000, 4096, 12) == (10, 10)


def test_copies_and_repeated_ids(spark):
    rnd = random.Random(4)
    corpus = [(100 - i, [1.0, 2.0, 3.0]) for i in range(40)] + [(7, [1.0, 2.0, 3.0])] * 9 + [(200 + i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    df = frame(spark, corpus)
    ids = lambda df: {(r.query_id, r["rank"]): r.cand_id for r in df.collect()}
    apart = ids(V.topk_cosine(df, "id", "v", df, "id", "v", 3, exclude_self=True, block=9, pivots=4))
    assert [apart[7, r] for r in (1, 2, 3)] == [61, 61, 61]  # nine questions of this id, the nearest id for each
    assert all(apart[i, r] == 7 for i in range(61, 101) for r in (1, 2, 3))
    asked = frame(spark, [(1, [2.0, 4.0, 6.0])])
    assert ids(V.topk_cosine(asked, "id", "v", df.where("id <> 7"), "id", "v", 3)) == {(1, 1): 61, (1, 2): 62, (1, 3): 63}
