"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

The mix has a size in words; every source gets a share of it by weight, at
most ``epochs`` times its own size, and what a source cannot take goes to
the others by weight.  A source first takes complete epochs.  The rest of
its target is a weighted sample without replacement (Efraimidis and
Spirakis, 2006): each document draws the exponential key -ln(u) / w, with w
its quality weight and u a hash of its id, source and text, so reruns agree.
Documents are ordered by key within their source and prefix-summed to the
budget; the document that crosses the budget is taken up to it, so that a
source takes its target to the word.

*Plan.*  Texts are read once, into (id, source, size, weight, hash).
Prefix sums cut a hot source into ranges (``prefix.running_sum``).  Sources
are ranked the same way, and the level at which all targets meet the total
is found by rounds of sums over the small table of sources; only those
sums come to the driver.

*Defined results.*  Null texts have size 0 and take nothing.  A null source
is a source of its own, last.  Null ids and repeated rows are rows like any
other; identical rows are interchangeable.  An empty table, or one without
words, gives targets and takings of 0.  Without ``weight_col`` the weight is
the share of letters in the text's visible bytes, at least 0.05; null or
non-positive given weights count as 0.05.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_view, col, fresh, steps
from quire.llm.prefix import running_sum
from quire.session import cut_lineage

PATTERN = (3, 1, 2)
LEAST_WEIGHT = 0.05

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def measure(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its share of letters among visible bytes."""
    if not len(raw):
        return np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
    space = SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begin = ~space & (first[:-1] | np.append(True, space[:-1]))
    sums = [np.append(0, np.cumsum(x)) for x in (begin, ~space, LETTER[raw])]
    words, seen, letters = (s[at[1:]] - s[at[:-1]] for s in sums)
    return words, letters / np.maximum(seen, 1)


def _measured(texts: pa.Array) -> pa.Array:
    """struct(size, weight, hash) of each text."""
    raw, at = byte_view(texts)
    view = memoryview(raw)
    size, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in steps(at):
        n, share = measure(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        size.append(n)
        weight.append(share)
    hashes = np.array([xxhash.xxh64_intdigest(view[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
    parts = [pa.array(np.concatenate(size)), pa.array(np.concatenate(weight)), pa.array(hashes.view(np.int64))]
    return pa.StructArray.from_arrays(parts, ["size", "weight", "hash"])


def source_targets(sizes: DataFrame, share: float, epochs: float, pattern: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("last", F.col("source").isNull().cast("int")).withColumn("key", F.coalesce("source", F.lit("")))
    ranked = running_sum(per.withColumn("one", F.lit(1)), [], ["last", "key"], "one", "rank")
    weights = F.array(*[F.lit(float(x)) for x in pattern])
    per = ranked.select(
        "source", "source_size", F.element_at(weights, (F.col("rank") % len(pattern) + 1).cast("int")).alias("w")
    )
    per = cut_lineage(per.withColumn("cap", F.col("source_size") * float(epochs)), "sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # raise the level until no further source reaches its cap
        full = F.col("w") * level >= F.col("cap")
        got = per.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if not got[1]:
            break
        now = (total - (got[0] or 0.0)) / got[1]
        if now <= level:
            break
        level = now
    return per.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    epochs: int = 2,
    pattern: tuple[int, ...] = PATTERN,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    keep: bool = False,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies.

    ``taken`` counts the words the mix takes, repeats included; ``copies`` are
    the complete ones, and taken - copies * size words more are the start of
    the text.  With ``keep`` the row also has all columns of ``docs``, as the
    struct ``row``.
    """
    weight = F.col("m.weight") if weight_col is None else F.coalesce(col(weight_col).cast("double"), F.lit(0.0))
    m = fresh(docs, "m")
    base = docs.withColumn(m, F.arrow_udf(_measured, "struct<size:bigint,weight:double,hash:bigint>")(col(text_col)))
    rows = base.select(
        col(id_col).alias("id"),
        col(source_col).cast("string").alias("source"),
        col(m).alias("m"),
        *([F.struct(*[col(c).alias(c) for c in docs.columns]).alias("row")] if keep else []),
        *([col(weight_col)] if weight_col else []),
    ).withColumn("w", F.greatest(weight, F.lit(LEAST_WEIGHT)))
    draw = F.shiftrightunsigned(F.xxhash64("id", "source", "m.hash", F.lit(seed)), 11)
    rows = rows.select(
        "id",
        "source",
        F.col("m.size").alias("size"),
        (-F.log((draw + 0.5) / float(1 << 53)) / F.col("w")).alias("key"),
        *(["row"] if keep else []),
    )
    rows = cut_lineage(rows, "sizes")
    targets = cut_lineage(source_targets(rows.select("source", "size"), share, epochs, pattern), "targets")
    named = rows.withColumn("last", F.col("source").isNull().cast("int")).withColumn("group", F.coalesce("source", F.lit("")))
    summed = running_sum(named, ["last", "group"], ["key", "id", "size"], "size", "before")
    targets = targets.withColumnRenamed("source", "of")
    out = summed.join(targets, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies)
    rest = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before")))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + part).cast("long").alias("taken"),
        "copies",
        *(["row"] if keep else []),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` for every document that the mix takes words of,
    with ``mix_copies`` (complete copies) and ``mix_words`` (words taken)."""
    got = mix(docs, keep=True, **options)
    extra = {"mix_copies": "copies", "mix_words": "taken"}
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return got.where("taken > 0").select(*own, *[F.col(v).alias(fresh(docs, k)) for k, v in extra.items()])
