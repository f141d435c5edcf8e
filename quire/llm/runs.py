"""Periodic runs of words, found by internal pattern matching.

A run is a longest possible stretch of words with smallest period q that is
at least max(``least``, 4 q) words long: a phrase of q words repeated four
times or more, the last time perhaps in part.  ``collapse`` keeps the first
q words of each run.

*Method* (internal pattern matching after Kociumaka, Radoszewski, Rytter and
Walen, 2015).  Texts are numbered words.  For each power of two L, the blocks
of L words that start at multiples of L are looked up in their right-hand
neighbourhood.  Every run of period q with (2L - 1) / 3 <= q < (4L - 1) / 3
holds an aligned block at s whose copy at s + q lies in the run too, so the
occurrences of the block that start in (s, s + (4L - 2) / 3] give all
candidate periods:

- the occurrences of a block are a range of the suffix array, and the next
  occurrence at or after a place is a *range successor* query, answered by a
  wavelet matrix over the suffix array (rank of the place in the range, then
  the entry of that rank);
- occurrences at most L / 2 apart form an arithmetic progression whose
  difference p is the block's period, so a progression is one step however
  many members it has.  A progression that starts at the block itself gives
  p.  Any other gives two candidates: the distances between the starts and
  between the ends of the p-periodic stretches around the block and around
  the progression, as a run of period q <> p repeats such a stretch at
  distance q.  A single occurrence gives its distance.  At most four
  progressions and single occurrences fit into the neighbourhood;
- a candidate (s, q) is extended to both sides as far as words q apart agree;
  of equal stretches the least period counts.

The suffix array comes from prefix doubling in which only places whose block
is still repeated are sorted again.  The classes of each doubling step are
kept: class equality compares blocks of 2^k words at once, which makes the
extensions exact, and a class is the block's range in the suffix array.

*Plan.*  A narrow pass: an Arrow function works on texts end to end, with a
unique word between them, in steps of about ``step_words`` words; equal texts
of a step are analysed once.  A longer text is a step of its own; memory is
about 4 bytes x words x log2(longest repeated stretch).

*Defined results.*  Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts
have no words and no runs, and collapse to the empty string.  Collapsed texts
are the kept words joined by one space.  Overlapping runs each drop their
words.  Runs are ordered by start, then period.  Repeated rows and null ids
are returned as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, text_bytes

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
NONE = np.iinfo(np.int64).max


class Factors:
    """Suffix array and the classes of all blocks of 2^k words.

    ``classes[k][i]`` is where the block at i starts in the suffix array, if
    blocks are ordered by their first 2^k words; ``sizes[k][i]`` says how many
    places share it.  The last word of ``words`` must be unique.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable").astype(np.int32)
        self.classes: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        key = words[order]
        slots, width = np.arange(n, dtype=np.int32), 1
        low = np.empty(n, np.int32)
        while True:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            low = low.copy()
            low[order[slots]] = np.repeat(slots[first], count)
            size = np.ones(n, np.int32)
            size[order[slots]] = np.repeat(count, count)
            self.classes.append(low)
            self.shared.append(size)
            slots = slots[np.repeat(count > 1, count)]
            if not len(slots):
                break
            at = order[slots]  # still repeated, hence at + width < n
            key = low[at].astype(np.int64) * n + low[at + width]
            new = np.argsort(key, kind="stable")
            order[slots], key = at[new], key[new]
            width *= 2
        self.order = order

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same (i < j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.classes) - 1, -1, -1):
            step = (self.classes[k][i] == self.classes[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def agree_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words just before i and just before j are the same (i < j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.classes) - 1, -1, -1):
            a = i - (1 << k)
            same = a >= 0
            same &= self.classes[k][np.maximum(a, 0)] == self.classes[k][np.maximum(j - (1 << k), 0)]
            step = same.astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def stretch(self, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch around s in which words q apart agree."""
        return s - self.agree_before(s, s + q), s + q + self.agree(s, s + q)


class Successor:
    """Range successor over a permutation, by a wavelet matrix of packed bits."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n, self.rows = n, []
        for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            bits = np.zeros((n // 64 + 1) * 64, bool)
            bits[:n] = one
            packed = np.packbits(bits, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.rows.append((bit, packed, before, n - int(before[-1])))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(packed, before, i):
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def at_least(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value >= x among the entries lo to hi, or NONE."""
        rank, a, b = np.zeros(len(x), np.int64), lo, hi
        for bit, packed, before, zeros in self.rows:
            a1, b1 = self._ones(packed, before, a), self._ones(packed, before, b)
            one = x >> bit & 1 > 0
            rank += np.where(one, (b - b1) - (a - a1), 0)
            a, b = np.where(one, zeros + a1, a - a1), np.where(one, zeros + b1, b - b1)
        rank = np.where(x >= self.n, hi - lo, rank)
        out = np.full(len(x), NONE)
        some = np.flatnonzero(rank < hi - lo)
        rank, a, b, value = rank[some], lo[some], hi[some], np.zeros(len(some), np.int64)
        for bit, packed, before, zeros in self.rows:
            a1, b1 = self._ones(packed, before, a), self._ones(packed, before, b)
            none = (b - b1) - (a - a1)
            one = rank >= none
            rank -= np.where(one, none, 0)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, zeros + a1, a - a1), np.where(one, zeros + b1, b - b1)
        out[some] = value
        return out


def candidates(f: Factors, find: Successor, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2^level words and the periods that their neighbourhood suggests."""
    size, low = f.shared[level], f.classes[level]
    width, reach = 1 << level, ((4 << level) - 2) // 3
    s = np.arange(0, len(low) - width + 1, width, dtype=np.int64)
    s = s[size[s] > 1]
    at, starts, periods = s + 1, [], []

    def suggest(s, q):
        starts.append(s)
        periods.append(q)

    while len(s):
        lo = low[s].astype(np.int64)
        hi = lo + size[s]
        o = find.at_least(lo, hi, at)
        near = o <= s + reach
        s, o, lo, hi = s[near], o[near], lo[near], hi[near]
        at = o + 1
        own = o - s <= width // 2  # the progression that the block itself starts
        p = (o - s)[own]
        suggest(s[own], p)
        at[own] = f.stretch(s[own], p)[1] - width + 1
        rest = np.flatnonzero(~own)
        following = find.at_least(lo[rest], hi[rest], o[rest] + 1)
        many = following - o[rest] <= width // 2
        one, rest = rest[~many], rest[many]
        suggest(s[one], (o - s)[one])
        p = following[many] - o[rest]
        b, e = f.stretch(s[rest], p)
        b2, e2 = f.stretch(o[rest], p)
        suggest(s[rest], b2 - b)
        suggest(s[rest], e2 - e)
        at[rest] = e2 - width + 1
    if not starts:
        return s, s
    s, q = np.concatenate(starts), np.concatenate(periods)
    fit = (3 * q >= 2 * width - 1) & (q <= reach)
    return s[fit], q[fit]


def find_runs(words: np.ndarray, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; the last word must be unique."""
    f = Factors(words)
    found = []
    find = Successor(f.order.astype(np.int64)) if len(f.classes) > 1 else None
    for level in range(1, len(f.classes)):
        s, q = candidates(f, find, level)
        if not len(s):
            continue
        b, e = f.stretch(s, q)
        ok = e - b >= np.maximum(least, 4 * q)
        found.append(np.stack([b[ok], e[ok], q[ok]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    b, e, q = np.concatenate(found, axis=1)
    by = np.lexsort((q, e, b))  # of the periods of one stretch the least comes first
    b, e, q = b[by], e[by], q[by]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (e[1:] != e[:-1])
    b, e, q = b[new], e[new], q[new]
    by = np.lexsort((q, b))
    return b[by], (e - b)[by], q[by]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) == 0


def _step(docs: list[list[bytes]], least: int):
    """Per text: runs as three arrays, and the collapsed text."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    size = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    words = np.empty(int(size.sum()) + len(docs), np.int64)
    for a, d in zip(begin.tolist(), docs):
        words[a : a + len(d)] = np.fromiter(map(number.__getitem__, d), np.int64, len(d))
    words[begin + size] = len(number) + np.arange(len(docs))
    start, length, period = find_runs(words, least)
    cut = np.searchsorted(start, np.append(begin, len(words)))
    for i, d in enumerate(docs):
        runs = slice(cut[i], cut[i + 1])
        b, n, q = start[runs] - begin[i], length[runs], period[runs]
        if len(b):
            d = [d[j] for j in np.flatnonzero(kept_words(len(d), b, n, q)).tolist()]
        yield b, n, q, b" ".join(d)


def _analyse(texts: pa.Array, least: int, step_words: int) -> Iterator[tuple]:
    """(words, starts, lengths, periods, collapsed) of each text."""
    place: dict[bytes, int] = {}
    rows: list[int] = []
    docs: list[list[bytes]] = []
    held = 0

    def flush():
        done = [(len(d), *r) for d, r in zip(docs, _step(docs, least))]
        yield from (done[i] for i in rows)

    for text in text_bytes(texts):
        if text not in place:
            words = text.split()
            if docs and held + len(words) > step_words:
                yield from flush()
                place, rows, docs, held = {}, [], [], 0
            place[text] = len(docs)
            docs.append(words)
            held += len(words) + 1
        rows.append(place[text])
    if rows:
        yield from flush()


def analysed(text: Column, least: int = 6, step_words: int = 1 << 17) -> Column:
    """(n_words, runs, collapsed) of each text."""

    @F.arrow_udf(RESULT)
    def analyse(texts: pa.Array) -> pa.Array:
        size, many, parts, kept = [], [0], [], []
        for n, *runs, collapsed in _analyse(texts, least, step_words):
            size.append(n)
            many.append(many[-1] + len(runs[0]))
            parts.append(runs)
            kept.append(collapsed)
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(RUN))
        return pa.StructArray.from_arrays(
            [
                pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(many, pa.int32()), runs),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["n_words", "runs", "collapsed"],
        )

    return analyse(text)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    step_words: int = 1 << 17,
) -> DataFrame:
    """(id, ``found``) of every row; ``found`` has n_words, runs and the collapsed text."""
    return docs.select(col(id_col).alias("id"), analysed(col(text_col), least, step_words).alias("found"))


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), where a tenth of the ids repeats a stretch to the text's end.

    With h the CRC-32 of the decimal id, g = h / 10 and n words, ids with
    h % 10 = 0 have each word i >= a replaced by word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) / (3 + g % 8).  Other texts, null ids and
    texts without words stay as they are.

    Written without lambda functions over structs: Spark 4.1.2 did not evaluate
    a Python function whose argument holds them.
    """
    h = F.crc32(col(id_col).cast("string").cast("binary"))
    words = F.array_remove(F.split(col(text_col), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(
        col(id_col).alias("id"),
        col(text_col).alias("t"),
        F.when(h % 10 == 0, words).alias("w"),
        F.floor(h / 10).alias("g"),
    )
    rows = rows.withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    unit = "slice(w, cast(a + 1 as int), cast(p as int))"
    tail = f"slice(flatten(array_repeat({unit}, cast((n - a) div p + 1 as int))), 1, cast(n - a as int))"
    text = F.expr(f"array_join(concat(slice(w, 1, cast(a as int)), {tail}), ' ')")
    return rows.select(col("id").alias(id_col), F.when(F.col("a").isNotNull(), text).otherwise(F.col("t")).alias(text_col))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of runs, the longest run, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, id_col, text_col)
    runs = F.col("found.runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    rows = found.select("id", "found", best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("found.runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000L * best.l div best.p").alias("exponent_milli"),
        "runs_sha256",
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
