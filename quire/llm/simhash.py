"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit SimHash of its word shingles.  Two texts link if
their fingerprints differ in at most ``radius`` bits; linked texts form
groups.

*Covering masks* (Pagh, "Locality-sensitive Hashing without False
Negatives", 2016): bit position i gets a non-zero vector m(i) of
radius + 1 bits.  For each non-zero vector v there is one table whose
mask keeps the positions with <m(i), v> = 1.  Any ``radius`` positions
span at most ``radius`` dimensions, so some v is orthogonal to all of
them: that table's mask keeps none of the positions in which the pair
differs, and the pair collides there.  2^(radius+1) - 1 tables therefore
miss no pair.

*Plan.*  Texts are read once, into (id, fingerprint).  Copies collapse
into distinct fingerprints by a map-side combined minimum.  Each
fingerprint goes to its tables; bucket sizes are a map-side combined
count.  A bucket of up to ``dense`` fingerprints is one small array, in
which a spanning forest is found with population counts.  Fingerprints of
larger buckets take an exact way whose work is linear in their number:
any two within ``radius`` bits share a point that is at most
ceil(radius / 2) bits from one and floor(radius / 2) from the other, so
each is sent to all points of its ball and the members of a point are
linked in a star.  No group is ever larger than a ball.  Components are
found by ``graph.connected_components``.

*Defined results.*  Null and empty texts have fingerprint zero and link
like any other.  Rows with a null id belong to their group but do not
name it; a group without ids has a null component.  Repeated rows are
returned as often as they come.  An empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import ASCII_LOWER, col, fresh, text_bytes
from quire.llm.graph import connected_components
from quire.session import cut_lineage

BITS = 64
SEED = 42
SALTS = 16  # parts of a component that are named apart


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; for any ``radius`` positions some mask keeps none."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)
    ]


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of one text: XXH64 of every shingle, the majority per bit."""
    tokens = text.translate(ASCII_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    width = min(words, len(tokens))
    stop = (ends[width - 1 :] - 1).tolist()
    start = [0, *ends[: len(stop) - 1].tolist()]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(stop), 1 << 15):
        part = np.array(
            [h(joined[s:e], SEED) for s, e in zip(start[i : i + (1 << 15)], stop[i : i + (1 << 15)])],
            np.uint64,
        )
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    major = np.packbits(2 * counts > len(stop), bitorder="little")
    return int(major.view("<i8")[0])


def simhash64(text: Column, words: int = 4) -> Column:
    """The fingerprint as a signed long; null and empty texts give zero."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in text_bytes(texts)], pa.int64())

    return simhash(text)


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values at ``radius`` bits or fewer."""
    todo, out = np.unique(values), []
    bits = todo.view(np.uint64)
    while len(bits) > 1:
        open_, bits = [bits[0]], bits[1:]
        while open_ and len(bits):
            p = open_.pop()
            near = np.bitwise_count(bits ^ p) <= radius
            if near.any():
                found = bits[near]
                bits = bits[~near]
                out += [(_signed(int(p)), _signed(int(f))) for f in found]
                open_.extend(found)
    return out


def near_edges(prints: DataFrame, radius: int, dense: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose closure links all
    pairs within ``radius`` bits."""
    masks = covering_masks(radius)
    entry = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    )
    keys = prints.select("fp", entry.alias("e")).select("fp", "e.t", "e.k")
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    # merged: Spark sizes an exploded table like its input, 31 times too low, and would broadcast it
    members = cut_lineage(keys.join(sizes.hint("merge"), ["t", "k"]), "buckets")

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def links(buckets: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.array(
            [[{"a": a, "b": b} for a, b in forest(np.asarray(x.values), radius)] for x in buckets], kind
        )

    small = (
        members.where(F.col("n") <= dense)
        .groupBy("t", "k")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode(links("fps")).alias("e"))
        .select("e.a", "e.b")
    )
    half = (radius + 1) // 2
    flips = [_signed(sum(1 << i for i in c)) for r in range(half + 1) for c in combinations(range(BITS), r)]
    point = F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x)))
    balls = (
        members.where(F.col("n") > dense)
        .select("fp")
        .distinct()
        .select("fp", point.alias("p"))
        .groupBy("p")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .where(F.size("fps") > 1)
    )
    if radius % 2:  # a ball also holds pairs one bit too far apart
        large = balls.select(F.explode(links("fps")).alias("e")).select("e.a", "e.b")
    else:
        large = balls.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return small.unionAll(large)


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    dense: int = 4096,
) -> DataFrame:
    """One row per input row: id, ``fp``, ``root`` (a fingerprint that names the
    group) and ``component_id`` (the group's smallest id)."""
    rows = cut_lineage(docs.select(col(id_col).alias("id"), simhash64(col(text_col), words).alias("fp")), "prints")
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    comps = connected_components(near_edges(prints, radius, dense))
    named = cut_lineage(prints.join(comps.withColumnRenamed("node", "fp").hint("merge"), "fp", "left"), "groups")
    linked = named.where(F.col("root").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # a component may be large: its fingerprints meet its name in SALTS places
    least = least.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    groups = linked.select("fp", "root", "_salt").join(least.hint("merge"), ["root", "_salt"]).select("fp", "root", "component_id")
    alone = named.where(F.col("root").isNull()).select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    groups = groups.unionAll(alone)
    return rows.join(groups.hint("merge"), "fp", "left").select(
        col("id").alias(id_col), "fp", "root", "component_id"
    )


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, dense: int = 4096) -> DataFrame:
    """id, ``fingerprint`` (16 hex digits) and ``component_id`` for every row."""
    out = simhash_groups(docs, id_col, text_col, words, radius, dense)
    return out.select(
        col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, dense: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one with the smallest id.

    Rows of one id may hold different texts and so belong to several groups;
    each group keeps a row of its own.  Rows without an id go if their group
    has an id, and otherwise the group keeps one of them.  Of repeated rows
    one stays.
    """
    groups = cut_lineage(simhash_groups(docs, id_col, text_col, words, radius, dense).withColumnRenamed(id_col, "_id"), "groups")
    row, rank, fp = fresh(docs, "_hash"), fresh(docs, "_id"), fresh(docs, "_fp")
    first = F.min(F.struct("_id", "fp")).alias("k")
    keep = groups.where(F.col("_id") == F.col("component_id")).groupBy("root").agg(first)
    keep = keep.select(F.col("k._id").alias(rank), F.col("k.fp").alias(fp))
    many = groups.where(F.col("_id").isNotNull()).groupBy(F.col("_id").alias(rank)).agg(F.count("*").alias("n"))
    many = cut_lineage(many.where("n > 1").select(rank), "repeated")
    # an id of one row is found by its id; only texts of repeated ids are hashed again
    once = keep.join(many, rank, "left_anti")
    stay = docs.join(once, col(id_col) == col(rank), "left_semi")
    if not many.isEmpty():
        again = cut_lineage(docs.join(many, col(id_col) == col(rank), "left_semi"), "repeated").withColumn(row, simhash64(col(text_col), words))
        again = again.join(keep, (col(id_col) == col(rank)) & (col(row) == col(fp)), "left_semi").dropDuplicates([id_col, row]).drop(row)
        stay = stay.unionByName(again)
    none = docs.where(col(id_col).isNull()).withColumn(row, simhash64(col(text_col), words))
    unnamed = groups.where(F.col("component_id").isNull()).groupBy("root").agg(F.min("fp").alias(rank)).select(rank)
    alone = none.join(unnamed, col(row) == col(rank), "left_semi").dropDuplicates([row]).drop(row)
    return stay.unionByName(alone)
