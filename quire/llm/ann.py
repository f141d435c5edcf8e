"""Approximate nearest neighbours by adaptive dimension scan of probed lists.

Vectors are scaled to length one, so the nearest by cosine is the nearest by
distance.  An inverted file deals them to the lists of a k-means clustering;
a query scans the ``probes`` lists with the nearest centres.  Within a list,
candidates are scanned by blocks of columns of randomly rotated vectors
(Gao and Long, "High-dimensional approximate nearest neighbor search", 2023):
after d of D columns a candidate's partial distance times D / d estimates its
distance with an error that shrinks with the square root of d, and it is
abandoned when a test of the hypothesis that it belongs to the current
nearest is rejected.  Survivors of the last block are scored with their
original vectors in double precision.

*Plan.*  Rows of equal id and vector are collapsed first by a combinable
aggregate.  The clustering and the rotation are fitted on a bounded sample
(``sample`` rows with the smallest hashes), and so is the number of lists
that a query probes; every row is indexed.  A list
with more than ``chunk`` rows is cut into chunks, and a list that many
queries probe has its queries cut the same way, so a group holds at most
about ``chunk`` rows of either side whatever the lists' sizes.  Each group
returns the nearest of each of its queries, and a top-k over the few rows of
a query follows.  ``exact`` scans every list, in blocks of candidates, and
measures recall.

*Defined results.*  Vectors that are null, zero, of another length than most
of the sample's, or hold null or non-finite components take no part; neither
do rows with a null id.  Rows that share an id are one candidate (its best
score counts) and one query.  Ties go to the smaller id.  With fewer
candidates than k all that are found are returned.  Extra columns are not
read.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col
from quire.session import cut_lineage


@dataclass
class Model:
    centres: np.ndarray  # lists x D, in rotated space
    rotation: np.ndarray  # D x D


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has only finite components, not all zero."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(vectors: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> Model:
    """k-means over unit vectors, and a random rotation."""
    rnd = np.random.default_rng(seed)
    dim = vectors.shape[1]
    rotation, _ = np.linalg.qr(rnd.normal(size=(dim, dim)))
    x = _unit(vectors) @ rotation
    distinct = np.unique(x, axis=0)
    lists = max(1, min(lists, len(distinct)))
    centres = distinct[rnd.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        owner = nearest_lists(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        size = np.bincount(owner, minlength=lists)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return Model(centres, rotation)


def nearest_lists(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest centres of each row, in blocks of rows."""
    half = (centres * centres).sum(1) / 2
    probes, out = min(probes, len(centres)), []
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        out.append(np.argpartition(d, probes - 1, axis=1)[:, :probes])
    return np.concatenate(out) if out else np.zeros((0, probes), np.int64)


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float, asked: int = 400) -> int:
    """Lists to probe so that ``target`` of the k nearest of some sample rows,
    found by brute force within the sample, lie in a probed list."""
    q = np.arange(0, len(x), max(1, len(x) // asked))
    owner = nearest_lists(x, centres, 1)[:, 0]
    half, need = (centres * centres).sum(1) / 2, []
    for i in q.tolist():
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(half - centres @ x[i], kind="stable")] = np.arange(len(centres))
        need.append(place[owner[best]] + 1)
    return int(np.quantile(np.concatenate(need), target, method="higher")) if need else 1


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.asarray(vectors.flatten(), float).reshape(len(vectors), -1)


def adaptive_scan(q: np.ndarray, rows: np.ndarray, k: int, block: int = 16, eps: float = 2.1, ids: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the candidates that survive all hypothesis tests; the k
    nearest of ``rows`` to ``q`` are among them with high probability.  With
    ``ids``, where some rows share an id, the rows of the k nearest ids."""
    n, dim = rows.shape
    if n <= 4 * k:
        return np.arange(n)
    start = ((rows[:, :block] - q[:block]) ** 2).sum(1)
    if ids is None:
        first = np.argpartition(start, 2 * k)[: 2 * k]
    else:  # a row of each of the 2 k nearest ids, so that the bound holds k ids
        order = np.argsort(start, kind="stable")
        first = order[np.sort(np.unique(ids[order], return_index=True)[1])[: 2 * k]]
        if len(first) < k:
            return np.arange(n)
    bound = np.partition(((rows[first] - q) ** 2).sum(1), k - 1)[k - 1] + 1e-9
    alive, part = np.arange(n), np.zeros(n)
    for d in range(0, dim, block):
        end = min(dim, d + block)
        part = part + ((rows[alive, d:end] - q[d:end]) ** 2).sum(1)
        # reject "is within the bound" if the scaled partial distance is too far beyond it
        loose = 1.0 if end == dim else (1 + eps / np.sqrt(end)) ** 2 * end / dim
        keep = part <= bound * loose + 1e-9
        alive, part = alive[keep], part[keep]
    return alive


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each row with q in double precision; equal rows score equally.
    Both are scaled by a power of two first, so that squares stay finite."""
    near = lambda x: x / 2.0 ** np.ceil(np.log2(np.abs(x).max(-1, keepdims=True)))
    q, rows = near(q), near(rows)
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def _scan_group(model: Model, k: int, exact: bool):
    def scan(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "v": [], "s": []}
        if len(cands) and len(queries):
            ids, vectors = cands.column("id").to_numpy(), _matrix(cands.column("vec"))
            rows = _unit(vectors) @ model.rotation
            asked, qs = queries.column("id").to_numpy(), _matrix(queries.column("vec"))
            turned = _unit(qs) @ model.rotation
            shared = len(np.unique(ids)) < len(ids)
            for i in range(len(asked)):
                other = np.flatnonzero(ids != asked[i])
                found = other if exact else other[adaptive_scan(turned[i], rows[other], k, ids=ids[other] if shared else None)]
                score = cosines(qs[i], vectors[found])
                order = np.lexsort((ids[found], -score))
                best, seen = [], set()
                for j in order:
                    v = int(ids[found[j]])
                    if v not in seen:
                        seen.add(v)
                        best.append((v, float(score[j])))
                        if len(best) == k:
                            break
                out["q"] += [asked[i]] * len(best)
                out["v"] += [v for v, _ in best]
                out["s"] += [s for _, s in best]
        return pa.table({"query_id": pa.array(out["q"], pa.int64()), "vec_id": pa.array(out["v"], pa.int64()), "score": pa.array(out["s"], pa.float64())})

    return scan


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    target: float = 0.97,
    lists: int = 256,
    sample: int = 20_000,
    chunk: int = 4096,
    exact: bool = False,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found.

    ``queries`` marks the query rows by a condition on ``id``.  So many lists are
    probed that they hold the share ``target`` of the sample's neighbours;
    ``lists`` is an upper bound, and no more than the square root of the sample
    are made.
    """
    spark = vectors.sparkSession
    vec = col(vec_col)
    rows = vectors.select(col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = cut_lineage(rows.dropDuplicates(["id", "vec"]), "vectors")
    picked = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).select("vec").toPandas()["vec"]  # at most `sample` rows
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(picked):
        return empty
    sizes, counts = np.unique([len(v) for v in picked], return_counts=True)
    dim = int(sizes[counts.argmax()])
    fitted = np.array([np.asarray(v, float) for v in picked if len(v) == dim])
    model = fit(fitted, 1 if exact else int(min(lists, max(1, np.sqrt(len(fitted))))))
    turned = _unit(fitted) @ model.rotation
    scanned = 1 if exact else probes_for(turned, model.centres, k, target)
    held = spark.sparkContext.broadcast(model)
    rows = rows.where(F.size("vec") == dim)

    def place(many: int):
        @F.arrow_udf("array<int>")
        def lists_of(vs: pa.Array) -> pa.Array:
            x = _unit(_matrix(vs)) @ held.value.rotation if len(vs) else np.zeros((0, dim))
            near = nearest_lists(x, held.value.centres, many)
            return pa.array(near.tolist(), pa.list_(pa.int32()))

        return lists_of("vec")

    index = rows.select("id", "vec", place(1)[0].alias("list"))
    asked = rows.where(queries).select("id", "vec")
    asked = cut_lineage(asked.select("id", "vec", F.explode(place(scanned)).alias("list")), "asked")
    # parts of each list: at most one row per list, so the table may be broadcast
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts"))
    asked_parts = asked.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("asks"))
    # (a list that is asked but not counted, by a rounding of its centre, has one)
    grid = F.broadcast(asked_parts.join(parts, "list", "left").select("list", "asks", F.coalesce("cuts", F.lit(1)).alias("cuts")))
    part = lambda n: F.pmod(F.xxhash64("id", "vec"), F.col(n)).cast("int")
    left = index.join(grid, "list").select("id", "vec", "list", part("cuts").alias("c"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("a"))
    right = asked.join(grid, "list").select("id", "vec", "list", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("c"), part("asks").alias("a"))
    keys = ["list", "c", "a"]
    scan = _scan_group(model, k, exact)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: scan(a, b), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every(divisor: int, name: str = "id") -> Column:
    """The rows whose id is divisible by ``divisor``."""
    return F.col(name) % divisor == 0
