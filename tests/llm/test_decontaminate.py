"""Edit matching against the plain dynamic programme."""

import random

from quire.llm import decontaminate as dc
from quire.llm import queries
from tests.conftest import SF_SMALL


def distance(item, text):
    """Least edit distance of the item to any substring, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_table():
    rnd = random.Random(4)
    for _ in range(200):
        item = "".join(rnd.choices("abc", k=rnd.randint(1, 90)))
        text = "".join(rnd.choices("abc", k=rnd.randint(0, 120)))
        assert dc.myers(dc.masks(item), len(item), text)[0] == distance(item, text)


def test_matcher_finds_every_match_within_budget():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("etaoin", k=rnd.randint(1, 4))) for _ in range(25)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(4, 30)))) for i in range(12)]
    matcher = dc.Matcher(items, 0.1, 20)
    for _ in range(60):
        _, item = rnd.choice(items)
        s = list(dc.normal(item))
        for _ in range(rnd.randint(0, int(len(s) * 0.14))):
            j = rnd.randrange(len(s))
            s[j : j + 1] = rnd.choice([[], ["x"], [s[j], "y"]])
        text = " ".join(rnd.choices(words, k=20)) + " " + "".join(s) + " " + " ".join(rnd.choices(words, k=20))
        got = {matcher.items[n][0]: d for n, d, _ in matcher.match(text)}
        for ident, item in items:
            d = distance(dc.normal(item), dc.normal(text))
            if len(dc.normal(item)) >= 20:
                assert got.get(ident) == (d if d <= dc.budget(len(dc.normal(item)), 0.1) else None)


def test_query_equals_table_on_fixture(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op7_decontaminate(spark, SF_SMALL).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if dc.normal(i.text) in dc.normal(d.text)}
    assert {k for k, v in got.items() if v == 0} == exact
    texts, rnd = {d.doc_id: dc.normal(d.text) for d in docs}, random.Random(1)
    sample = [(d, i) for d in rnd.sample(docs, 6) for i in rnd.sample(items, 3)] + [
        (d, i) for d in docs for i in items if (d.doc_id, i.item_id) in got and got[d.doc_id, i.item_id]
    ]
    for d, i in sample:
        want = distance(dc.normal(i.text), texts[d.doc_id])
        assert (want <= dc.budget(len(dc.normal(i.text)), 0.06)) == ((d.doc_id, i.item_id) in got)


def test_edge_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, item.upper().replace(" ", " \n"), 1), (4, "x " * 50000 + item + " y" * 50000, 1), (5, item.replace("fox", "fax"), 1),
         (6, "short one", 1), (7, "a short one in a text", 1), (None, item, 1), (3, item, 1), (8, item[:50], 1)],
        "doc_id long, text string, distance int",
    )
    bench = spark.createDataFrame([(1, item, "q"), (2, None, "q"), (3, "", "q"), (4, " Short  ONE", "q"), (5, item, "q")], "item_id long, text string, doc_id string")
    rows = sorted((str(r.doc_id), r.item_id, r.distance) for r in dc.contaminated(docs, bench).collect())
    assert rows == sorted([(d, i, int(d == "5")) for d in ("3", "3", "4", "5", "None") for i in (1, 5)] + [("6", 4, 0), ("7", 4, 0)])
    assert dc.contaminated(docs, bench, block_chars=10).count() == len(rows)
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 8]
    assert dc.contaminated(docs, bench.limit(0)).collect() == [] and dc.contaminated(docs.limit(0), bench).collect() == []
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 10


def test_short_items_stand_between_word_boundaries():
    matcher = dc.Matcher([(1, "fox"), (2, "Go!"), (3, "a b"), (4, "é"), (5, "nineteen characters")], 0.06, 20)
    found = lambda t: {matcher.items[n][0]: end for n, _, end in matcher.match(t)}
    assert found("The fox.") == {1: 7} and found("fox") == {1: 3} and found("foxes firefox fox1") == {}
    assert found("ready, go! now") == {2: 10} and found("go!x") == {}
    assert found("na b, a  b") == {3: 9} and found("é") == {4: 1} and found("née") == {}
    assert found("x " * 50_000 + "nineteen characters") == {5: 100_019}
    assert found("nineteen charakters") == {}
