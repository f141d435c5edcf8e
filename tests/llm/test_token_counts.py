"""Token counts against the libraries' own encoding of whole texts."""

import base64
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer as Fast

from quire.llm import queries
from quire.llm.token_counts import build, lengths, token_counts
from tests.conftest import SF_SMALL

MODEL = "piece_bpe_32k.model"


def whole(name):
    """The library's count of one whole text."""
    if name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return lambda t: len(sp.encode(t))
    if name.endswith(".json"):
        fast = Fast.from_file(P.path(name))
        return lambda t: len(fast.encode(t, add_special_tokens=False).ids)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t))


def made(name):
    with open(P.path(name), "rb") as f:
        return build(name[name.rindex(".") :], f.read(), P.PATTERN)


def odd_texts(seed, n=150):
    rnd = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "a", "the", "Ing", "▁", "é", "é", "漢字", "😀", "<s>", "</s>", "<|endoftext|>", "'s", "'", "12", ".", " ", "\x00", "İ", "x" * 9, " of the"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", [MODEL, "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("part", [1, 5, 23])
def test_cut_texts_count_like_whole_ones(name, part):
    tok, want = made(name), whole(name)
    texts = odd_texts(part)
    cuts = [len(list(tok.parts(t, part))) for t in texts if t]
    assert max(cuts) > 3  # the boundaries are used
    assert all("".join(tok.parts(t, part)) == t for t in texts)
    assert lengths(tok, texts, 64, part) == [want(t) for t in texts]


def test_query_equals_whole_encoding(spark):
    want, docs = whole(MODEL), spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, SF_SMALL).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), n := want(r.text), n > 4096) for r in docs}


def test_edge_rows(spark):
    long = "word " * 300_000 + "z" * 100_000 + "\n" * 1000 + "end "
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (None, "a b"), (5, long), (6, "漢" * 70_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_tokens string, over_limit int")
    got = token_counts(docs, P.path(MODEL))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and dict(got.dtypes)["n_bytes"] == "bigint"
    want = whole(MODEL)
    expect = [(i, len((t or "").encode()), want(t or ""), want(t or "") > 4096) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expect, key=str)
    assert token_counts(docs.limit(0), P.path(MODEL)).collect() == []
    named = docs.select("text", docs.doc_id.alias("n_tokens"))
    assert token_counts(named, P.path(MODEL), id_col="n_tokens").columns == ["n_tokens", "n_bytes", "_n_tokens", "over_limit"]


def test_wrong_files_raise(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts(docs, str(tmp_path / "x.bin"))
    with pytest.raises(ValueError):
        token_counts(docs, P.path("byte_bpe_50k.tiktoken"))
