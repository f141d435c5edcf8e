"""Sub-word codecs of public tokenizer files: lengths, encode, decode.

Nothing is trained here.  A codec is made from a ``.json`` (tokenizers) or
``.model`` (sentencepiece) file; it carries the file's bytes, at most
``MOST_FILE`` of them, so executors need not see the folder, and a Python
worker builds it once.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_FILE = 64 << 20
_built: dict[str, object] = {}


@dataclass(frozen=True)
class Subword:
    kind: str
    data: bytes
    name: str

    @classmethod
    def from_file(cls, path: str) -> "Subword":
        kind = os.path.splitext(path)[1]
        if kind not in (".json", ".model"):
            raise ValueError(f"no codec for {kind!r} files")
        if os.path.getsize(path) > MOST_FILE:
            raise ValueError(f"{path}: a tokenizer file may have {MOST_FILE} bytes")
        with open(path, "rb") as f:
            data = f.read()
        return cls(kind, data, hashlib.sha256(data).hexdigest())

    def _codec(self):
        """The library's object, one a worker: another file takes its place."""
        if self.name not in _built:
            _built.clear()
            if self.kind == ".json":
                from tokenizers import Tokenizer

                codec = Tokenizer.from_str(self.data.decode())
                codec.no_truncation()
                codec.no_padding()
                codec.encode_special_tokens = True  # their strings in texts are text
            else:
                import sentencepiece

                codec = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            _built[self.name] = codec
        return _built[self.name]

    def encode(self, text: str) -> list[int]:
        codec = self._codec()
        return codec.encode_batch_fast([text], add_special_tokens=False)[0].ids if self.kind == ".json" else codec.encode(text)

    def decode(self, ids: list[int]) -> str:
        codec = self._codec()
        return codec.decode(ids, skip_special_tokens=False) if self.kind == ".json" else codec.decode(ids)

    def length(self, text: str) -> int:
        """Length function for the splitter: number of sub-words."""
        return len(self.encode(text))

    def encode_column(self, text: Column) -> Column:
        """Sub-word ids of each text; null stays null."""

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else np.asarray(self.encode(t), np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return encode.asNondeterministic()(text)  # ids that are used twice are made once

    def decode_column(self, ids: Column) -> Column:
        """The text of each array of ids; null stays null."""

        @F.arrow_udf(T.StringType())
        def decode(rows: pa.Array) -> pa.Array:
            return pa.array([None if r is None else self.decode(r) for r in rows.to_pylist()], pa.string())

        return decode(ids)
