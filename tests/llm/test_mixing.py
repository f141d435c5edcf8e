"""Targets by water filling, takings near them, reruns equal."""

import math
import random
from collections import defaultdict

from quire.llm import mixing, queries
from tests.conftest import SF_SMALL


def brute_targets(sizes, share=1.5, epochs=2, pattern=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: pattern[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if per * w[s] > epochs * sizes[s]}
        if not over:
            return target | {s: per * w[s] for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    size = {i: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    per, taken = defaultdict(int), defaultdict(int)
    for i, _, s in docs:
        per[s] += size[i]
    want = brute_targets(per)
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.copies * r["size"] <= r.taken <= min(2, r.copies + 1) * r["size"]
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 1


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = queries.op5_mixing(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = queries.op5_mixing(spark, SF_SMALL).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_edge_rows(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "B", "é", "", None, "hot", "hot", "hot"])) for i in range(300)]
    docs += [(400, None, "a"), (401, "", "empty"), (402, "one two " * 40000, "long"), (403, None, "none"), (404, "x y z", "nbsp")]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, source string, size string, key double")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    kept = mixing.mixed_documents(df)
    assert kept.columns == [*df.columns, "mix_copies", "mix_words"]
    assert {r.doc_id: r.mix_words for r in kept.collect()} == {r.doc_id: r.taken for r in rows if r.taken}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(None, "a b", None)] * 3, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 8 and sum(r.taken for r in rows) == round(1.5 * 21)
    assert mixing.mix(df.limit(0)).collect() == []
    blank = df.withColumn("text", df.source.substr(5, 1))
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(blank).collect())


def test_weights_matter(spark):
    """Heavy documents are drawn far more often, for any seed."""
    rows = [(i, "w " * 10, "a", 10.0 if i < 100 else 0.1) for i in range(200)] + [(1000 + i, "w " * 10, "b", 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = {r.doc_id: r.taken for r in mixing.mix(df, share=0.3, pattern=(1, 1), weight_col="q").collect()}
    heavy, light = sum(got[i] > 0 for i in range(100)), sum(got[i] > 0 for i in range(100, 200))
    assert heavy > 90 and light < 70 and heavy > light
