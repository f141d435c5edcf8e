"""Phrase replacement from a lexicon table, leftmost-longest.

Reading from the left, at each place the longest phrase that starts there is
replaced and reading goes on behind it.  Texts are read in slices of at most
``SLICE`` characters (or one text).  For each length that a phrase has, the
hashes of all windows of a slice come from one array of prefix sums and meet
the sorted hashes of the phrases; equal hashes are compared character by
character, so the result is exact.

The lexicon goes to the executors in blocks of at most ``block_chars``
characters, each a broadcast of that size; a lexicon over ``most_chars`` is
refused.  A Python worker holds a block as two Arrow arrays, its characters as
numbers and 16 bytes a phrase, and nothing but the replaced text leaves it.
The choice between matches is made over all blocks.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 19  # characters that are searched at once
COMPARED = 1 << 21  # characters that are compared at once
APART = 0xFFFFFFFF  # between two texts of a slice: no character
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def characters(texts: list[str]) -> np.ndarray:
    """The characters of the texts as numbers, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)  # the two of a slice
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _up_to(n: int, base: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64; those of a slice are held."""
    return _powers(max(n, 2 * SLICE), base)[: n + 1]


class Hashes:
    """Polynomial hashes (modulo 2^64) of any window of some characters."""

    def __init__(self, chars: np.ndarray):
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed *= _up_to(len(chars), _BASE)[:-1]
        self.sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mixed, out=self.sums[1:])
        self.back = _up_to(len(chars), pow(_BASE, -1, 1 << 64))

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all windows of n characters."""
        many = max(0, len(self.sums) - n)
        return (self.sums[n:] - self.sums[:many]) * self.back[:many]

    def spans(self, starts: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[starts + n] - self.sums[starts]) * self.back[starts]


class Block:
    """Phrases with their replacements, found by length and hash."""

    def __init__(self, sources: pa.Array, targets: pa.Array):
        texts = sources.to_pylist()
        self.targets, self.chars = targets, characters(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(size) - size
        hashes = Hashes(self.chars)
        self.of_length = {}
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            found = hashes.spans(self.start[which], n)
            order = np.argsort(found)
            found, which = found[order], which[order].astype(np.int32)
            bits = max(10, (16 * len(found)).bit_length())
            shift = np.uint64(64 - bits)
            maybe = np.zeros(1 << bits, bool)  # first bits of the hashes there are
            maybe[found >> shift] = True
            same = int(np.unique(found, return_counts=True)[1].max())  # phrases of one hash
            self.of_length[n] = (found, which, shift, maybe, same)

    def at(self, chars: np.ndarray, windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, phrases): where phrases of n characters stand."""
        found, which, shift, maybe, same = self.of_length[n]
        places = np.flatnonzero(maybe[windows >> shift])
        first = np.searchsorted(found, windows[places])
        out = []
        for more in range(same):
            near = np.minimum(first + more, len(found) - 1)
            hit = np.flatnonzero(found[near] == windows[places])
            out.append(self._equal(chars, places[hit], which[near[hit]], n))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _equal(self, chars: np.ndarray, places: np.ndarray, phrases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        kept, step, width = np.zeros(len(places), bool), max(1, COMPARED // n), np.arange(n)
        for i in range(0, len(places), step):
            there, mine = places[i : i + step, None] + width, self.start[phrases[i : i + step], None] + width
            kept[i : i + step] = (chars[there] == self.chars[mine]).all(axis=1)
        return places[kept], phrases[kept]


def replaced(texts: list[str], blocks: list[Block]) -> list[str]:
    """The texts with the leftmost-longest phrases of all blocks replaced."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(size + 1) - size - 1  # one place between two texts
    chars = np.insert(characters(texts), np.cumsum(size), APART)
    hashes = Hashes(chars)
    longest, block_of, phrase = np.zeros(len(chars), np.int32), np.zeros(len(chars), np.int32), np.zeros(len(chars), np.int32)
    for n in sorted({n for b in blocks for n in b.of_length if n <= max(size, default=0)}):
        windows = hashes.windows(n)
        for k, block in enumerate(blocks):
            if n in block.of_length:
                places, phrases = block.at(chars, windows, n)
                longest[places], block_of[places], phrase[places] = n, k, phrases
    places = np.flatnonzero(longest)
    taken, done = [], 0
    for i, (a, b) in enumerate(zip(places.tolist(), (places + longest[places]).tolist())):
        if a >= done:
            taken.append(i)
            done = b
    places = places[taken]
    to = np.empty(len(places), object)
    for k, block in enumerate(blocks):
        mine = np.flatnonzero(block_of[places] == k)
        to[mine] = block.targets.take(pa.array(phrase[places[mine]])).to_pylist()
    edges = np.searchsorted(places, starts).tolist() + [len(places)]
    begins, ends, to, out = places.tolist(), (places + longest[places]).tolist(), to.tolist(), []
    for t, (text, base) in enumerate(zip(texts, starts.tolist())):
        parts, done = [], 0
        for i in range(edges[t], edges[t + 1]):
            parts += text[done : begins[i] - base], to[i]
            done = ends[i] - base
        out.append("".join([*parts, text[done:]]))
    return out


def slices(texts: list[str | None]) -> Iterator[list[int]]:
    """The numbers of the texts, in lists of at most SLICE characters (or one text)."""
    mine, held = [], 0
    for i, t in enumerate(texts):
        if t is not None:
            if mine and held + len(t) > SLICE:
                yield mine
                mine, held = [], 0
            mine.append(i)
            held += len(t) + 1
    if mine:
        yield mine


_built: dict[int, tuple] = {}


def _block(held) -> Block:
    """A broadcast block, made once in a Python worker."""
    value = held.value
    if id(value) not in _built:
        _built[id(value)] = (value, Block(*value))
    return _built[id(value)][1]


def blocks(lexicon: DataFrame, block_chars: int, most_chars: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(sources, targets) of each block; of several targets the smallest counts."""
    table = lexicon.where(F.length("source") > 0).groupBy("source").agg(F.min("target").alias("target")).where(F.col("target").isNotNull())
    size = F.length("source") + F.length("target")
    total = table.agg(F.sum(size)).first()[0] or 0
    if total > most_chars:
        raise ValueError(f"the lexicon has {total} characters; {most_chars} may be broadcast")
    block, held = [], 0
    for r in table.orderBy("source").toLocalIterator():
        if block and held + len(r.source) + len(r.target) > block_chars:
            yield tuple(pa.array(side, pa.string()) for side in zip(*block))
            block, held = [], 0
        block.append((r.source, r.target))
        held += len(r.source) + len(r.target)
    if block:
        yield tuple(pa.array(side, pa.string()) for side in zip(*block))


def replace_phrases(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    out_col: str | None = None,
    block_chars: int = 4_000_000,
    most_chars: int = 64_000_000,
) -> DataFrame:
    """``df`` with the phrases of ``lexicon`` (source, target) replaced in ``text_col``.

    Null texts stay null; empty phrases and null targets take no part.
    """
    spark, out_col = df.sparkSession, out_col or text_col
    held = [spark.sparkContext.broadcast(b) for b in blocks(lexicon, block_chars, most_chars)]
    kept = [c for c in df.columns if c != out_col]
    if not held:
        return df.select(*kept, F.col(text_col).alias(out_col))
    return df.withColumn(out_col, _whole(held)(F.col(text_col))).select(*kept, out_col)


def _whole(held: Iterable):
    @F.arrow_udf(T.StringType())
    def whole(texts: pa.Array) -> pa.Array:
        found, rows = [_block(h) for h in held], texts.to_pylist()
        for mine in slices(rows):
            for i, text in zip(mine, replaced([rows[i] for i in mine], found)):
                rows[i] = text
        return pa.array(rows, pa.string())

    return whole
