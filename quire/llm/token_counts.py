"""Token counts of whole texts by a public tokenizer.

The tokenizer is given by its file: ``.model`` (sentencepiece), ``.json``
(tokenizers) or ``.tiktoken`` (ranks, with the split pattern as a
parameter).  The file's bytes, at most ``MOST_FILE`` of them, are broadcast,
so executors need not see the folder; a Python worker builds the tokenizer
once.

*Plan.*  One narrow pass: an Arrow function gets the texts and returns one
long per row; tokens never leave it.  Inside, long texts are cut into parts
of about ``part_bytes`` at *safe boundaries*, parts are packed into batches
of at most ``batch_bytes`` whatever the number of rows, each batch is
encoded by one library call, and the lengths are summed per row.

*Safe boundaries.*  A cut must not change the tokens on either side.
  sentencepiece BPE: tokens only arise by merging neighbours into a piece of
  the vocabulary, so a place between two characters that stand side by side
  in no piece can never lie inside a token.  These pairs are read from the
  vocabulary.  Parts after the first are encoded by a second processor with
  the leading-space rule switched off.  Models that rewrite text (other
  normalisers, white-space removal, user-defined symbols, unigram) are not cut.
  byte-level and word BPE: their patterns start a new word at a space that
  stands between two ASCII letters, so the cut goes before such a space.
A text without a safe boundary stays whole.

*Defined results.*  Null and empty texts have 0 bytes and 0 tokens.  Rows
are returned as often as they come, null ids included.  No begin, end or
other special tokens are added; their strings inside texts are ordinary
text to sentencepiece and tiktoken, and special tokens to tokenizers, as
these libraries do by default.  Nothing is truncated.  An empty table gives
an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col, fresh

MOST_FILE = 64 << 20
SPACE = "▁"  # sentencepiece writes a space so
# a space between ASCII letters; the cut goes before the space
WORD_START = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

Count = Callable[[list[str]], list[int]]
Cut = Callable[[str, int], int]


def _never(text: str, at: int) -> int:
    return len(text)


def _word_cut(text: str, at: int) -> int:
    found = WORD_START.search(text, at)
    return found.start() if found else len(text)


class Tokenizer:
    """``first`` counts tokens of texts (or of their first parts), ``later`` of
    further parts; ``cut`` finds the first safe place at or after one."""

    def __init__(self, first: Count, later: Count, cut: Cut):
        self.first, self.later, self.cut = first, later, cut

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of about ``size`` characters, cut where it is safe."""
        start = 0
        while len(text) - start > size:
            end = self.cut(text, start + size)
            yield text[start:end]
            start = end
        if start < len(text) or not start:
            yield text[start:]


def _sentencepiece(data: bytes) -> Tokenizer:
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(data)
    norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
    whole = sp.SentencePieceProcessor(model_proto=data)

    def count(proc):
        return lambda texts: list(map(len, proc.encode(texts, num_threads=1)))

    plain = (
        model.trainer_spec.model_type == pb.TrainerSpec.BPE
        and not norm.precompiled_charsmap
        and not norm.remove_extra_whitespaces
        and norm.escape_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
        and all(p.type != kinds.USER_DEFINED for p in model.pieces)
    )
    if not plain:
        return Tokenizer(count(whole), count(whole), _never)
    joined = {
        a + b
        for p in model.pieces
        if p.type == kinds.NORMAL
        for a, b in zip(p.piece, p.piece[1:])
    }

    def cut(text: str, at: int) -> int:
        for i in range(at, len(text)):
            if text[i - 1 : i + 1].replace(" ", SPACE) not in joined:
                return i
        return len(text)

    norm.add_dummy_prefix = False
    rest = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
    return Tokenizer(count(whole), count(rest), cut)


def _tokenizers(data: bytes) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    from tokenizers import Tokenizer as Fast

    fast = Fast.from_str(data.decode())
    fast.no_truncation()
    fast.no_padding()

    def count(texts):
        return [len(e.ids) for e in fast.encode_batch(texts, add_special_tokens=False)]

    return Tokenizer(count, count, _word_cut)


def _tiktoken(data: bytes, pattern: str) -> Tokenizer:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(texts):
        return [len(enc.encode_ordinary(t)) for t in texts]

    return Tokenizer(count, count, _word_cut)


def build(kind: str, data: bytes, pattern: str | None = None) -> Tokenizer:
    if kind == ".model":
        return _sentencepiece(data)
    if kind == ".json":
        return _tokenizers(data)
    if kind == ".tiktoken" and pattern:
        return _tiktoken(data, pattern)
    raise ValueError(f"no tokenizer for {kind!r} files" + (" without a pattern" if kind == ".tiktoken" else ""))


_last: list = [None, None]


def _built(held) -> Tokenizer:
    """The tokenizer of a broadcast; a worker holds the last one only."""
    if _last[0] != held.value:
        _last[:] = [held.value, build(*held.value)]
    return _last[1]


def lengths(tok: Tokenizer, texts: list[str | None], batch_bytes: int, part_bytes: int) -> list[int]:
    """Tokens per text; parts are encoded in batches of about ``batch_bytes``."""
    out = [0] * len(texts)
    waiting: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
    held = {True: 0, False: 0}

    def flush(first: bool) -> None:
        rows = waiting[first]
        for (i, _), n in zip(rows, (tok.first if first else tok.later)([t for _, t in rows])):
            out[i] += n
        waiting[first], held[first] = [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        for k, part in enumerate(tok.parts(text, part_bytes) if len(text) > part_bytes else (text,)):
            first, size = k == 0, len(part.encode())
            if waiting[first] and held[first] + size > batch_bytes:
                flush(first)
            waiting[first].append((i, part))
            held[first] += size
    for first in (True, False):
        if waiting[first]:
            flush(first)
    return out


def token_length(
    spark: SparkSession,
    text: Column,
    path: str,
    pattern: str | None = None,
    batch_bytes: int = 1 << 20,
    part_bytes: int = 1 << 16,
) -> Column:
    """Tokens of each text as a long; null texts have none."""
    size = os.path.getsize(path)
    if size > MOST_FILE:
        raise ValueError(f"{path}: {size} bytes; a tokenizer file may have {MOST_FILE}")
    with open(path, "rb") as f:
        data = f.read()
    kind = os.path.splitext(path)[1]
    if kind not in (".model", ".json", ".tiktoken") or (kind == ".tiktoken" and not pattern):
        build(kind, data, pattern)  # raises here, not in a task
    held = spark.sparkContext.broadcast((kind, data, pattern))

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _built(held)
        for texts in batches:
            yield pa.array(lengths(tok, texts.to_pylist(), batch_bytes, part_bytes), pa.int64())

    return tokens(text)


def token_counts(
    docs: DataFrame,
    path: str,
    pattern: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    part_bytes: int = 1 << 16,
) -> DataFrame:
    """id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    text, size, n = col(text_col), fresh(docs.select(col(id_col)), "n_bytes"), fresh(docs.select(col(id_col)), "n_tokens")
    rows = docs.select(
        col(id_col),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(size),
        token_length(docs.sparkSession, text, path, pattern, batch_bytes, part_bytes).alias(n),
    )
    return rows.withColumn(fresh(rows, "over_limit"), col(n) > limit)
