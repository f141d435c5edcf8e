"""Looking words up in a table of any size.

The tokens of a row become its distinct words and one code per token.  Only
distinct (row, word) pairs are shuffled: once to meet the table, once back to
their row.  A word is in a row once, so a frequent word's share of the pairs
is at most one a row; adaptive execution splits the partition it falls into.
The values come back as one array per row, aligned with its words, and a
token's value is ``values[code]``.  A small table goes to the tasks instead,
and nothing is shuffled (``small_table``, ``in_place``).  So does a larger one
of numbers as 64-bit hashes, if no two of its words share one (``hashed``).

Where every token is looked up, rows are taken together in blocks of bounded
size: a word meets the table once a block, and only codes travel with the
rows (``blocked``, ``looked_up``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut_lineage

SMALL_WORDS, SMALL_CHARS = 50_000, 1 << 22  # a table up to these goes to the tasks


def _numbers(kind: type, parts: list[list[int]]) -> pa.Array:
    flat = np.concatenate([np.asarray(p, kind) for p in parts]) if parts else np.zeros(0, kind)
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _strings(parts: list[list[str]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([w for p in parts for w in p], pa.string()))


LIGHT = 200_000  # values that a Python worker holds as objects at once


def light_slices(rows: pa.Array, depth: int = 1) -> Iterator[pa.Array]:
    """The rows of a list array in slices of at most ``LIGHT`` inner values (or one
    row), so that what becomes Python objects does not grow with the batch.
    ``depth`` 2 weighs the lists inside lists of structs."""
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if depth > 1 and len(sizes):
        flat = rows.flatten()
        inner = sum(flat.field(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields))
        ends = np.concatenate([[0], np.cumsum(inner)])
        stop = np.cumsum(sizes)
        sizes = ends[stop] - ends[stop - sizes]
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > LIGHT:
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if start < len(rows):
        yield rows.slice(start)


def as_lists(rows: pa.Array) -> list[list]:
    """The rows of a list array as Python lists (a null one is empty), its values
    converted in one go."""
    flat = rows.flatten()
    items = flat.to_pylist() if flat.null_count else flat.to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum([0, *rows.value_lengths().fill_null(0).to_pylist()]).tolist()
    return [items[a:b] for a, b in zip(ends, ends[1:])]


# distinct words of a row, and each token's place among them
CODED = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("codes", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(CODED)
def coded(tokens: pa.Array) -> pa.Array:
    """Distinct tokens in order of appearance, and each token's place among them."""
    words, codes = [], []
    for row in tokens.to_pylist():
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        codes.append([number[t] for t in row or ()])
        words.append(list(number))
    return pa.StructArray.from_arrays([_strings(words), _numbers(np.int32, codes)], ["words", "codes"])


def numbered(df: DataFrame, *cols: Column) -> DataFrame:
    """``df`` with the given columns and ``_row``, a number of its own for each
    row (keys may repeat or be null), written once so that it stays the same."""
    return cut_lineage(df.select("*", *cols).withColumn("_row", F.monotonically_increasing_id()), "rows")


def pairs(rows: DataFrame, words: Column) -> DataFrame:
    """(_row, k, word): the distinct words of each row with their places."""
    out = rows.select("_row", F.posexplode_outer(words).alias("k", "word"))
    return out.where(F.col("k").isNotNull())


def values(rows: DataFrame, words: Column, table: DataFrame, default, name: str = "values") -> DataFrame:
    """Adds ``name``: for each word of a row its ``value`` in ``table`` (word,
    value; one row a word), or ``default``."""
    kind = table.schema["value"].dataType
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    found = pairs(rows, words).join(table.select("word", "value"), "word", "left")
    found = found.withColumn("value", F.coalesce("value", F.lit(default).cast(kind)))
    lists = found.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias(name))
    return rows.join(lists, "_row", "left").withColumn(name, F.coalesce(name, empty))


def hits(rows: DataFrame, words: Column, table: DataFrame, name: str = "hits") -> DataFrame:
    """Adds ``name``: the places of a row's words that ``table`` (word, value) holds,
    with their values.  Only those come back to the row."""
    found = pairs(rows, words).join(table.select("word", "value"), "word")
    lists = found.groupBy("_row").agg(F.collect_list(F.struct("k", "value")).alias(name))
    return rows.join(lists, "_row", "left")


def per_token(found: Column, codes: Column, kind: T.DataType) -> Column:
    """Per token the value of its word in ``hits``, or null."""

    @F.arrow_udf(T.ArrayType(kind))
    def spread(found: pa.Array, codes: pa.Array) -> pa.Array:
        sizes = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        n, m = sizes(codes), sizes(found)
        flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        pair = found.flatten()
        place = pair.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        width = np.zeros(len(n), np.int64)
        np.maximum.at(width, row, flat + 1)
        base = np.cumsum(width) - width
        slot = np.full(int(width.sum()), -1, np.int64)
        slot[np.repeat(base, m) + place] = np.arange(len(place))
        hit = slot[base[row] + flat]
        values = pair.field(1).take(pa.array(np.maximum(hit, 0), mask=hit < 0)) if len(place) else pa.nulls(len(hit), pair.field(1).type)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)

    return spread(found, codes)


BLOCK = 1 << 20  # tokens (and rows) of a block


def blocked(df: DataFrame, tokens: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep``, with ``_block``, ``_coded`` (each token's place among the
    distinct ones of its block, -1 for a null) and ``_words`` (the block's distinct
    tokens, on one row of it); written once.  A longer row is a block of its own."""
    rows = df.select(*keep, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_block"))
    kind = rows.schema["_tokens"].dataType
    fields = [*(rows.schema[c] for c in keep), T.StructField("_block", T.LongType())]
    schema = T.StructType([*fields, T.StructField("_coded", T.ArrayType(T.IntegerType())), T.StructField("_words", kind)])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        one = {c: table[c].chunk(0) for c in table.column_names}
        coded = one["_tokens"].flatten().dictionary_encode()
        ends = np.cumsum([0, *one["_tokens"].value_lengths().fill_null(0).to_pylist()]).astype(np.int32)
        codes = pa.ListArray.from_arrays(pa.array(ends), coded.indices.fill_null(-1))
        words = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(table), len(coded.dictionary))).astype(np.int32)), coded.dictionary)
        number = pa.array(np.full(len(table), one["_block"][0].as_py()))
        return pa.RecordBatch.from_arrays([*(one[c] for c in keep), number, codes, words], schema.names)

    def cut(batches):
        held, n = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("_tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            i, done = 0, 0
            while i < len(batch):
                j = min(len(batch), int(np.searchsorted(ends, done + BLOCK - n)) + 1)
                held.append(batch.slice(i, j - i))
                n, done, i = n + int(ends[j - 1]) - done, int(ends[j - 1]), j
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return cut_lineage(rows.mapInArrow(cut, schema), "blocks")


def looked_up(rows: DataFrame, table: DataFrame, default, name: str) -> DataFrame:
    """``blocked`` rows with ``name``: per token its ``value`` in ``table`` (word, value;
    one row a word), or ``default``.  A block meets its values in one task."""
    pairs_ = rows.select(F.col("_block").alias("_at"), F.posexplode("_words").alias("k", "word"))
    found = pairs_.join(table.select("word", "value"), "word").select("_at", "k", "value")
    keep = [c for c in rows.columns if c not in ("_block", "_coded", "_words")]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.ArrayType(table.schema["value"].dataType))])

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        codes = pa.concat_arrays(left["_coded"].chunks)
        flat = codes.flatten().to_numpy(zero_copy_only=False)
        place = right["k"].to_numpy()
        slot = np.full(1 + max(flat.max(initial=-1), place.max(initial=-1)) + 1, -1, np.int64)  # the last is for code -1
        slot[place] = np.arange(len(place))
        hit = slot[flat]
        kind = right.schema.field("value").type
        values = right["value"].chunk(0).take(pa.array(np.maximum(hit, 0), mask=hit < 0)) if len(place) else pa.nulls(len(hit), kind)
        ends = np.cumsum([0, *codes.value_lengths().to_pylist()]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), values.fill_null(default))
        return left.select(keep).append_column(name, lists)

    return rows.drop("_words").groupBy("_block").cogroup(found.groupBy("_at")).applyInArrow(spread, schema)


def small_table(table: DataFrame, words: int | None = None, chars: int | None = None) -> pa.Table | None:
    """The rows of ``table`` (word, value) that have a word, or None above the small sizes."""
    words, chars = SMALL_WORDS if words is None else words, SMALL_CHARS if chars is None else chars
    rows = table.select("word", "value").where(F.col("word").isNotNull())
    size = rows.limit(words + 1).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    return rows.toArrow() if size["n"] <= words and (size["chars"] or 0) <= chars else None


def in_place(tokens: Column, table: pa.Table, kind: T.DataType) -> Column:
    """Per token its value in a small table (one row a word), or null: no shuffle."""
    words, found = table["word"].combine_chunks(), table["value"].combine_chunks()

    @F.arrow_udf(T.ArrayType(kind))
    def looked_up(tokens: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        place = pc.index_in(tokens.flatten(), value_set=words)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.take(place))

    return looked_up(tokens)


HASHED = 1 << 23  # words whose hashes and values go to the tasks (9 bytes each)


@dataclass
class Hashed:
    """A table (word, value) by the hashes of its words, in order; values are whole
    numbers below 128, and a word that is not held has the value ``default``."""

    keys: np.ndarray
    values: np.ndarray
    default: int

    def of(self, hashes: pa.Array) -> np.ndarray:
        """The value of each hash; that of a null is 0."""
        there = pc.is_valid(hashes).to_numpy(zero_copy_only=False)
        asked = hashes.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.full(len(asked), self.default, np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[place] == asked
            out[hit] = self.values[place[hit]]
        out[~there] = 0
        return out

    def lists(self, hashes: pa.Array) -> pa.Array:
        """``of`` for the rows of a list array."""
        ends = np.concatenate([[0], np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.of(hashes.flatten())))


def hashes(words: Column) -> Column:
    """The hashes that ``Hashed`` asks for; null for a null word."""
    return F.transform(words, lambda w: F.when(w.isNotNull(), F.xxhash64(w)))


def hashed(table: DataFrame, default: int) -> Hashed | None:
    """``table`` (word, value; one row a word, all words that will be asked for) by
    hashes; words of the ``default`` value are not held.  None if two words share
    a hash or more than ``HASHED`` words would be held."""
    keys = table.where(F.col("word").isNotNull()).select(F.xxhash64("word").alias("hash"), F.col("value").cast("tinyint").alias("value"))
    held = F.col("value") != default
    size = keys.groupBy("hash").agg(F.count("*").alias("n"), F.count_if(held).alias("held")).agg(F.max("n"), F.sum("held")).first()
    if (size[0] or 0) > 1 or (size[1] or 0) > HASHED:
        return None
    rows = keys.where(held).toArrow()
    one, value = rows["hash"].to_numpy(), rows["value"].to_numpy()
    order = np.argsort(one)
    return Hashed(one[order], value[order], default)


def counted(rows: DataFrame, words: Column, some: Column) -> tuple[DataFrame, int]:
    """(word, df) of the rows where ``some`` holds, ``words`` being a row's distinct
    words without nulls, and the number of those rows; written once.  Counts are
    combined map-side, and a null of each row counts the rows in the same pass."""
    each = F.when(some, F.concat(words, F.array(F.lit(None).cast("string"))))
    every = rows.select(F.posexplode_outer(each).alias("k", "word")).where(F.col("k").isNotNull())
    counts = cut_lineage(every.groupBy("word").agg(F.count("*").alias("df")), "word-counts")
    total = counts.where(F.col("word").isNull()).agg(F.sum("df")).first()[0] or 0
    return counts.where(F.col("word").isNotNull()), total


def document_counts(rows: DataFrame, words: Column) -> DataFrame:
    """(word, df): in how many rows each word stands; counts are combined map-side."""
    return pairs(rows, words).groupBy("word").agg(F.count("*").alias("df"))
