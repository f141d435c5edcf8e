"""Fixed-size bitmaps over hashes, built by Spark and broadcast.

A bitmap has at most 2^28 bits (32 MB) whatever the input, so it may be
broadcast.  It only ever lets too much through, never too little: callers
use it to drop rows before a shuffle and decide exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28


def bits_for(entries: float, per_entry: int = 8, most: int = MOST_BITS) -> int:
    """Bits of slot number for so many entries, within fixed bounds."""
    return int(min(most, max(16, np.ceil(np.log2(max(entries, 1) * per_entry)))))


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set; ``bitmap`` is an array of bytes."""
    s = slot(h, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0


SLICE = 4096  # words of a slice of a bitmap


def _slices(batches):
    """Words (slice, place, bits), sorted by slice, as one row of bytes per slice."""
    now, words = None, None
    for batch in batches:
        part, place, bits = (np.asarray(batch.column(i)) for i in range(3))
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]))):
            if a == b:
                continue
            if part[a] != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int64()), "bytes": pa.array([words.tobytes()], pa.binary())})
                now, words = int(part[a]), np.zeros(SLICE, np.int64)
            words[place[a:b]] |= bits[a:b]
    if now is not None:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int64()), "bytes": pa.array([words.tobytes()], pa.binary())})


def of_column(df: DataFrame, h: Column, bits: int) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes: bits are OR-ed per word by Spark,
    words are packed into slices, and at most 2^bits bits come to the driver."""
    s = F.shiftrightunsigned(h, 64 - bits)
    words = df.select(F.shiftright(s, 6).alias("w"), F.expr("1L").alias("one"), s.bitwiseAND(63).cast("int").alias("b"))
    words = words.select("w", F.expr("shiftleft(one, b)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    split = words.select(F.floor(F.col("w") / SLICE).alias("slice"), (F.col("w") % SLICE).alias("place"), F.col("v").alias("bits"))
    parts = max(1, (1 << (bits - 6)) // SLICE // 16)
    packed = split.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_slices, "slice long, bytes binary")
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in packed.collect():
        part = np.frombuffer(r["bytes"], np.int64)[: len(out)]
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return out.view(np.uint8)
