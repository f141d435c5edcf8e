"""Sub-word codecs: round trips, lengths, and chunks measured by them."""

import public_tokenizers as P
import pytest

import __spark_entry__ as E
from quire.operators import chunk as C
from quire.operators.subword import Subword
from tests.conftest import SF_SMALL

TEXTS = ["", " ", "Hello  world\n", "漢字 é 😀 <|endoftext|>", "x" * 3000, None]


def test_byte_level_round_trip(spark):
    codec = Subword.from_file(P.path("byte_bpe_50k.json"))
    assert all(codec.decode(codec.encode(t)) == t for t in TEXTS if t is not None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    ids = df.select("id", codec.encode_column(df.text).alias("ids"))
    assert {r.id: r.ids for r in ids.collect()} == {i: None if t is None else codec.encode(t) for i, t in enumerate(TEXTS)}
    back = ids.select("id", codec.decode_column(ids.ids).alias("t")).collect()
    assert {r.id: r.t for r in back} == dict(enumerate(TEXTS))


def test_codecs_take_turns_in_a_worker(spark):
    a, b = (Subword.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    df = spark.createDataFrame([("some words here",)], "text string")
    row = df.select(a.encode_column(df.text).alias("a"), b.encode_column(df.text).alias("b"), a.encode_column(df.text).alias("c")).first()
    assert row.a == row.c == a.encode("some words here") and row.b == b.encode("some words here")


def test_wrong_files_raise(tmp_path):
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(ValueError):
        Subword.from_file(str(tmp_path / "x.txt"))


def test_chunks_keep_to_the_sub_word_size(spark):
    codec = Subword.from_file(P.path("byte_bpe_50k.json"))
    rows = E.queries()["recursive_chunks_subword"](spark, SF_SMALL).collect()
    assert len(rows) > 300
    seps = set(C.CJK_SEPARATORS)
    for r in rows[:800]:  # longer only where no separator is left to cut at
        assert codec.length(r.chunk) <= 128 or not any(s in r.chunk.strip()[:-1] for s in seps if s)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert all(r.chunk in texts[r.doc_id] for r in rows)
    assert {r.doc_id for r in rows} == {i for i, t in texts.items() if t and t.strip()}
