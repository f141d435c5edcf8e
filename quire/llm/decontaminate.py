"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some substring of it is within
``rate`` x length edits of the item (both lower-cased, white space runs as
one space).  With an error budget of k edits the item is split into k + 1
pieces; k edits leave at least one piece untouched, so every match holds an
exact piece at about its place.  An Aho-Corasick automaton over all pieces
finds the exact hits in one pass over a text; each hit predicts where the
item would start, hits that agree are one window, and a window is verified
with Myers' bit-parallel distance (Myers, 1999) for approximate search.

*Plan.*  The test items are a stated query set; they go to the executors in
blocks of at most ``block_chars`` characters, and each block scans all
documents in a narrow pass.  Nothing is shuffled but the matches.

*Defined results.*  Null and empty texts and items match nothing.  Items
shorter than ``least`` characters have no error budget and must stand between
word boundaries: no letter or digit may touch them.  Repeated items are matched once per
row; repeated and null document ids get rows of their own.  Empty tables
give empty results.  Long texts are scanned whole.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of this length."""
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces with their offsets, their lengths as even as possible."""
    n = len(item)
    cut = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of its places in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of length m to a substring of
    ``text``, and the first place where such a substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton and bit masks of one block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float, least: int):
        self.short: set[int] = set()
        self.items, owners = [], {}
        for ident, text in items:
            item = normal(text)
            if not item:
                continue
            n, k = len(self.items), budget(len(item), rate) if len(item) >= least else 0
            self.items.append((ident, item, k, masks(item)))
            if len(item) < least:
                self.short.add(n)
            for at, piece in pieces(item, k):
                owners.setdefault(piece, []).append((n, at))
        self.find = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.find.add_word(piece, (len(piece), who))
        if owners:
            self.find.make_automaton()
        self.any = bool(owners)

    def match(self, text: str | None):
        """(item number, distance, end) of the best match of each item that matches."""
        s = normal(text)
        if not self.any or not s:
            return
        starts: dict[int, set[int]] = {}
        for end, (size, who) in self.find.iter(s):
            for n, at in who:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        for n, where in sorted(starts.items()):
            _, item, k, peq = self.items[n]
            if n in self.short:
                ends = [a + len(item) for a in sorted(where) if not (s[a - 1 : a].isalnum() or s[a + len(item) : a + len(item) + 1].isalnum())]
                if ends:
                    yield n, 0, ends[0]
                continue
            best = None
            for lo, hi in self._windows(sorted(where), len(item), k, len(s)):
                exact = s.find(item, lo, hi)
                got = (0, exact + len(item)) if exact >= 0 else myers(peq, len(item), s[lo:hi])
                if exact < 0:
                    got = (got[0], got[1] + lo)
                if got[0] <= k and (best is None or got < best):
                    best = got
                if best and best[0] == 0:
                    break
            if best:
                yield n, *best

    @staticmethod
    def _windows(starts: list[int], size: int, k: int, length: int):
        """Predicted starts within 2k of each other share a window."""
        lo = prev = starts[0]
        for s in starts[1:]:
            if s - prev > 2 * k:
                yield max(0, lo - k), min(length, prev + size + k)
                lo = s
            prev = s
        yield max(0, lo - k), min(length, prev + size + k)


def blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int):
    """Lists of (item, text) of bounded size, streamed from a sorted table."""
    block, size = [], 0
    rows = items.select(col(item_col).alias("i"), col(text_col).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.06,
    least: int = 20,
    block_chars: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and item that it contains: id, item, distance
    and ``end`` (where the best match ends in the normalised text)."""
    spark = docs.sparkSession
    kind, item_kind = docs.select(col(id_col)).schema[0].dataType, benchmark.select(col(item_col)).schema[0].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField(item_col, item_kind), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]
    )
    texts, out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")), None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        held = spark.sparkContext.broadcast((block, rate, least))
        found = texts.mapInArrow(_scanner(held, id_col, item_col), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _scanner(held, id_col: str, item_col: str):
    def scan(batches):
        matcher = Matcher(*held.value)
        for batch in batches:
            rows, item, distance, end = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                for n, d, e in matcher.match(text.as_py()):
                    rows.append(i)
                    item.append(matcher.items[n][0])
                    distance.append(d)
                    end.append(e)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(item), pa.array(distance, pa.int32()), pa.array(end, pa.int64())] if rows else
                [ids, pa.array([], _kind_of(held)), pa.array([], pa.int32()), pa.array([], pa.int64())],
                [id_col, item_col, "distance", "end"],
            )

    return scan


def _kind_of(held):
    return pa.array([ident for ident, _ in held.value[0][:1]]).type


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 20, block_chars: int = 1_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no test item; a narrow filter per block."""
    spark = docs.sparkSession
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.where(_is_clean(spark.sparkContext.broadcast((block, rate, least)))(col(text_col)))
    return docs


def _is_clean(held):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        matcher = _matcher(held)
        return pa.array([next(matcher.match(t.as_py()), None) is None for t in texts], pa.bool_())

    return clean


MOST_BUILT = 8  # matchers that a Python worker holds
_built: dict[int, tuple[object, Matcher]] = {}


def _matcher(held) -> Matcher:
    """The block's matcher, built once in a Python worker; the oldest go first."""
    block = held.value
    if id(block) not in _built:
        while len(_built) >= MOST_BUILT:
            del _built[next(iter(_built))]
        _built[id(block)] = (block, Matcher(*block))  # holding the block keeps its id its own
    return _built[id(block)][1]
