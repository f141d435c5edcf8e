"""Token records: vocabulary, encode/decode, padding, masks.

The vocabulary is a table ``(token, id, n)`` of every token of the corpus.
Encoding and decoding are joins of the distinct tokens of blocks of rows with
it (``operators.lookup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import lookup as L
from quire.operators.aggregate import blocked_row_number
from quire.session import cut_lineage

# Fixed ids of the special tokens (our vocabulary layout).
PAD, UNK, BOS, EOS = 0, 1, 2, 3
SPECIALS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]"]
IGNORE_INDEX = -100


def build_vocab(tokens_df: DataFrame, tokens_col: str) -> DataFrame:
    """All tokens with dense ids after the specials, by (count desc, token asc).

    Counts are combined map-side; the ids are numbered inside ranges of the
    order, with each range's offset from a table of one row per range.  The
    table is written once, and this runs when the query is built.
    """
    counts = tokens_df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    parts = int(tokens_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, F.desc("n"), F.asc("token")).withColumn("part", F.spark_partition_id())
    ranked = blocked_row_number(cut_lineage(ranged, "counts"), [], F.col("part"), [F.desc("n"), F.asc("token")])
    return cut_lineage(ranked.select("token", (F.col("rn") - 1 + len(SPECIALS)).cast("int").alias("id"), "n"), "vocab")


def token_ids(rows: DataFrame, tokens: Column, vocab: DataFrame, out_col: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``out_col``, one id per token;
    unknown tokens give ``UNK``."""
    held = L.blocked(rows, tokens, rows.columns if keep is None else keep)
    return L.looked_up(held, vocab.select(F.col("token").alias("word"), F.col("id").alias("value")), UNK, out_col)


def with_markers(ids: Column, add_special: bool = True, limit: int | None = None) -> Column:
    """Ids between their markers, cut so that they fit ``limit`` with them."""
    if limit is not None:
        ids = F.slice(ids, 1, limit - 2 * add_special)
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS))) if add_special else ids


def encode_df(
    df: DataFrame, key, tokens_col: str, vocab: DataFrame, out_col: str = "ids", add_special: bool = True, limit: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``out_col``, the ids of ``tokens_col``; unknown tokens give ``UNK``.

    ``key`` names the row columns that callers group by; rows are looked up in
    blocks, so it may repeat or be null.  ``keep`` are the columns that go with the
    ids, all if not given.  With ``limit`` the ids are cut so that they fit
    it with both markers, which always stay.
    """
    out = token_ids(df, F.col(tokens_col), vocab, out_col, keep)
    return out.withColumn(out_col, with_markers(F.col(out_col), add_special, limit))


def decode_df(df: DataFrame, key, ids_col: str, vocab: DataFrame, out_col: str = "text", skip_special: bool = True, sep: str = " ") -> DataFrame:
    """Adds ``out_col``, the tokens of ``ids_col`` joined by ``sep``; unknown ids
    show as ``[UNK]``, the other specials are left out."""
    ids = F.filter(ids_col, lambda i: (i >= len(SPECIALS)) | (i == UNK)) if skip_special else F.col(ids_col)
    table = vocab.select(F.col("id").alias("word"), F.col("token").alias("value"))
    if not skip_special:  # their names, where the vocabulary has no token of that id
        names = df.sparkSession.createDataFrame(list(enumerate(SPECIALS)), "word int, value string")
        table = table.unionAll(names.join(table, "word", "left_anti"))
    kept = [c for c in df.columns if c != out_col]
    rows = L.looked_up(L.blocked(df, ids, kept), table, SPECIALS[UNK], "_words")
    return rows.select(*kept, F.array_join("_words", sep).alias(out_col))


def pad_truncate(ids: Column, length: int, pad: int = PAD) -> Column:
    """Exactly ``length`` ids: cut, or right-padded with ``pad``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.slice(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length)), 1, length)


def mask_labels(labels: Column, pad: int = PAD) -> Column:
    """Padding ids -> -100 so the loss ignores them."""
    return F.transform(labels, lambda x: F.when(x == pad, F.lit(IGNORE_INDEX)).otherwise(x))


def unmask_labels(labels: Column, pad: int = PAD) -> Column:
    """-100 -> padding id before decoding (always applied here)."""
    return F.transform(labels, lambda x: F.when(x == IGNORE_INDEX, F.lit(pad)).otherwise(x))


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
