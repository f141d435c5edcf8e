"""Scalar text functions, lexicons, templates and token records."""

import re

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import clean as K
from quire.operators import tokens as TK


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_clean_order_keeps_two_spaces(spark):
    assert _one(spark, X.clean_text(F.col("v")), "a - b") == "a  b"


def test_contractions(spark):
    assert _one(spark, X.normalize_contractions(F.col("v")), "i can't go, won't stay") == "i cannot go, will not stay"
    # punctuation removal first: the apostrophe is gone before the rules run
    assert _one(spark, X.clean_text(F.col("v")), "I can't") == "i cant"
    assert _one(spark, X.normalize_contractions(F.col("v")), "scan't") == "scan't"


def test_python_whitespace_semantics(spark):
    s = "　 a b\x1c c \x85"
    assert _one(spark, X.py_strip(F.col("v")), s) == s.strip()
    assert _one(spark, X.ws_tokens(F.col("v")), s) == s.split()
    assert _one(spark, X.collapse_ws(F.col("v")), s) == re.sub(r"\s+", " ", s)


def test_punctuation_matches_python(spark):
    s = "Héllo, wörld! ¿Qué? 你好。1_2 (x) «y» ½"
    assert _one(spark, X.strip_punct(F.col("v")), s) == re.sub(r"[^\w\s]", "", s)


def test_template_leaves_braces_in_data(spark):
    out = _one(spark, X.render_template("<{document}>", document=F.col("v")), "{summary}")
    assert out == "<{summary}>"


def test_metadata_null_prints_none(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert df.select(X.format_metadata(F.col("a"), F.col("b"))).first()[0] == "案件類型: None\n爭點: x\n"


def test_segment_words(spark):
    assert _one(spark, X.segment_words(F.col("v")), "判決abc 12甲") == ["判", "決", "abc", "12", "甲"]


def test_stop_words_keep_duplicates(spark):
    df = spark.createDataFrame([(["a", "a", "b"],)], "t array<string>")
    assert df.select(K.remove_stop_words(F.col("t"), ["b"])).first()[0] == ["a", "a"]


def test_stop_words_from_a_table(spark):
    lex = spark.createDataFrame([(w,) for w in ["b", "c", "zz"]], "word string")
    df = spark.createDataFrame([(1, ["a", "b", "a", "c", "d"])], "id long, t array<string>")
    out = K.remove_stop_words_df(df, "id", "t", lex, "kept").first()["kept"]
    assert out == ["a", "a", "d"]


def test_synonyms(spark):
    df = spark.createDataFrame([(["the", "cat", "the"],)], "t array<string>")
    assert df.select(K.replace_synonyms(F.col("t"), {"the": "a"})).first()[0] == ["a", "cat", "a"]
    lex = spark.createDataFrame([("cat", "feline", 2), ("cat", "kitty", 1)], "word string, synonym string, rank int")
    df2 = spark.createDataFrame([(1, ["the", "cat"])], "id long, t array<string>")
    assert K.replace_synonyms_df(df2, "id", "t", lex, "o").first()["o"] == ["the", "kitty"]


def test_padding_mask_and_back(spark):
    df = spark.createDataFrame([([5],)], "ids array<int>")
    padded = TK.pad_truncate(F.col("ids"), 3)
    row = df.select(padded.alias("p"), TK.mask_labels(padded).alias("m"), TK.attention_mask(F.col("ids"), 3).alias("a")).first()
    assert row.p == [5, 0, 0]
    assert row.m == [5, -100, -100]
    assert row.a == [1, 0, 0]
    back = df.select(TK.unmask_labels(TK.mask_labels(padded)).alias("u")).first()["u"]
    assert back == [5, 0, 0]


def test_vocab_encode_decode_roundtrip(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, ["a", "b", "d"]), (3, [])], "id long, tok array<string>")
    vocab = TK.build_vocab(docs, "tok")
    assert {r.token: r.id for r in vocab.collect()} == {"b": 4, "a": 5, "c": 6, "d": 7}  # count desc, then token
    enc = TK.encode_df(docs, "id", "tok", vocab)
    assert {r.id: r.ids for r in enc.collect()} == {1: [TK.BOS, 4, 5, 4, 6, TK.EOS], 2: [TK.BOS, 5, 4, 7, TK.EOS], 3: [TK.BOS, TK.EOS]}
    dec = TK.decode_df(enc.select("id", "ids"), "id", "ids", vocab)
    assert {r.id: r.text for r in dec.collect()} == {1: "b a b c", 2: "a b d", 3: ""}


def test_unknown_tokens_and_cuts_keep_the_markers(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, ["zz"])], "id long, tok array<string>")
    vocab = TK.build_vocab(docs.where("id = 1"), "tok")
    cut = {r.id: r.ids for r in TK.encode_df(docs, ["id"], "tok", vocab, limit=4).collect()}
    assert cut == {1: [TK.BOS, 4, 5, TK.EOS], 2: [TK.BOS, TK.UNK, TK.EOS]}
    dec = TK.decode_df(TK.encode_df(docs, "id", "tok", vocab).select("id", "ids"), "id", "ids", vocab)
    assert {r.id: r.text for r in dec.collect()}[2] == "[UNK]"
