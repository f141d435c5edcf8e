"""Lookups by blocks of rows: a word meets the table once a block, whatever the rows."""

from pyspark.sql import functions as F

from quire.operators import lookup as L
from quire.operators import tokens as TK


def test_blocks_share_their_words(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 40)
    data = [(i % 7 or None, ["a", "b", None, f"w{i % 3}", "a"] if i % 5 else None if i % 2 else []) for i in range(60)] + [(1, ["x"] * 100)]
    df = spark.createDataFrame(data, "id int, tok array<string>").coalesce(1)
    table = spark.createDataFrame([("a", 4), ("w0", 5), ("w2", 6), ("unseen", 7)], "word string, value int")
    rows = L.blocked(df, F.col("tok"), ["id"])
    sizes = rows.groupBy("_block").agg(F.sum(F.size("_coded")).alias("n"), F.sum(F.size("_words")).alias("w"))
    assert all(r.w <= 6 and (r.n <= 45 or r.n >= 100) for r in sizes.collect()) and sizes.count() > 5
    known = {"a": 4, "w0": 5, "w2": 6}
    want = [(i, [known.get(w, 1) for w in t or []]) for i, t in data]
    assert sorted(map(repr, want)) == sorted(repr((r.id, r.v)) for r in L.looked_up(rows, table, 1, "v").collect())


def test_pairs_of_rows_and_words_are_not_shuffled(spark):
    """Equal rows of a block give their words to the join once, in both directions."""
    df = spark.createDataFrame([(i, ["of", "the", "sea"]) for i in range(50)], "id int, tok array<string>").coalesce(1)
    vocab = spark.createDataFrame([("of", 4, 2), ("sea", 5, 1)], "token string, id int, n int")
    ids = TK.encode_df(df, "id", "tok", vocab, keep=["id"])
    assert {tuple(r.ids) for r in ids.collect()} == {(TK.BOS, 4, TK.UNK, 5, TK.EOS)} and ids.columns == ["id", "ids"]
    assert L.blocked(df, F.col("tok"), ["id"]).select(F.explode("_words")).count() == 3
    text = TK.decode_df(ids, "id", "ids", vocab, skip_special=False)
    assert {r.text for r in text.collect()} == {"[BOS] of [UNK] sea [EOS]"} and text.count() == 50
