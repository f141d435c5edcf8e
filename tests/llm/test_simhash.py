"""SimHash groups against all pairs, on the fixture and on planted clusters."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import queries
from quire.llm.graph import connected_components
from quire.llm.simhash import covering_masks, keep_one, near_edges, simhash_near_dedup
from tests.conftest import SF_SMALL


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = words + [w] * bool(w), ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=4):
    """Smallest id reachable, by search over all pairs."""
    ids = sorted(prints)
    label = {}
    for i in ids:
        if i not in label:
            todo = [i]
            label[i] = i
            while todo:
                p = todo.pop()
                for j in ids:
                    if j not in label and (prints[p] ^ prints[j]).bit_count() <= radius:
                        label[j] = i
                        todo.append(j)
    return label


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference(radius):
    masks, rnd = covering_masks(radius), random.Random(1)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        diff = sum(1 << i for i in rnd.sample(range(64), radius))
        assert any(m & diff == 0 for m in masks)


def test_query_equals_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF_SMALL).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints)


@pytest.mark.parametrize("radius,dense", [(4, 4096), (4, 3), (3, 3), (2, 3)])
def test_dense_buckets_lose_no_link(spark, radius, dense):
    rnd, prints = random.Random(7), set()
    for _ in range(6):  # clusters whose members lie 0 to 9 bits from a centre
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 9)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    comps = {r.node: r.root for r in connected_components(near_edges(df, radius, dense)).collect()}
    want = brute_groups({x: x & (1 << 64) - 1 for x in signed}, radius)
    assert {x: comps.get(x, x) for x in signed} == want


def test_edge_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one two"),
        (7, "a " * 50000), (8, "a " * 50000), (4, "one two"), (None, "one two"), (None, "lonely words only here now"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    got = simhash_near_dedup(docs)
    out = [(r.doc_id, r.component_id) for r in got.collect()]
    assert len(out) == len(rows)
    assert sorted((i, c) for i, c in out if i) == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7)]
    assert sorted(str(c) for i, c in out if i is None) == ["4", "None"]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "None"]
    assert simhash_near_dedup(docs.limit(0)).collect() == [] and keep_one(docs.limit(0)).collect() == []


def test_repeated_ids_lose_no_text(spark):
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five six", "quite another text of its own here"
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (1, b), (4, b), (None, a), (None, "no id and no copy anywhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(0))
    got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, "no id and no copy anywhere")], key=str)
    hot = spark.range(3000).selectExpr("7L AS doc_id", "concat('text number ', id % 50, ' word', id % 50, ' more', id % 50) AS text")
    kept = keep_one(hot)
    assert {r.text for r in kept.collect()} and kept.select("doc_id").distinct().count() == 1
    groups = simhash_near_dedup(hot.dropDuplicates(["text"])).select("fingerprint").distinct().count()
    assert kept.count() <= groups  # one row a group, none of them lost
    prints = {int(r.fingerprint, 16) for r in simhash_near_dedup(hot).collect()}
    near = brute_groups({x: x for x in prints})
    assert kept.count() == len(set(near.values()))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (None, 3), (3, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}
