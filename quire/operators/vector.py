"""Vectors: hashing embedder, exact cosine top-k, upsert, dimension checks.

Top-k retrieval never forms query x corpus pairs as rows.  The corpus is cut
into cells around pivots; a question meets only the cells whose members can
be near enough, in tiles of many questions by many members, which keep ``k``
candidates per query.  A final ``row_number() <= k`` (planned as a ``WindowGroupLimit``)
picks the global top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut_lineage


# ------------------------------------------------------------------ embedding

def token_bucket(token: Column, dim: int) -> Column:
    """Stable bucket of a token: first 32 bits of its md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_counts(tokens: Column, dim: int) -> Column:
    """Bag-of-words feature hashing: ``array<int>`` of bucket counts.

    Tokens are hashed on the JVM; an Arrow function counts the buckets of a
    whole batch at once, in time linear in the tokens.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def counted(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        counts = np.bincount(row * dim + flat, minlength=n * dim).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(counts))

    return counted(F.transform(tokens, lambda t: token_bucket(t, dim).cast("int")))


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element fold)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def l2_normalize(vec: Column) -> Column:
    def norm_of(v):
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        return _bind(n, lambda nv: F.when(nv > 0, F.transform(v, lambda x: x.cast("double") / nv)))

    return _bind(vec, norm_of)


def hash_embed(tokens: Column, dim: int = 64) -> Column:
    """Deterministic default embedder: L2-normalised hashed counts."""
    return l2_normalize(hash_counts(tokens, dim))


def embed_batches(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list], list],
    out_col: str = "embedding",
    batch_size: int = 64,
    element_type: T.DataType = T.FloatType(),
) -> DataFrame:
    """Pluggable embedder hook: ``fn(list[str]) -> list[vector]`` on batches.

    Rows stay keyed (the function's output is attached to its own rows),
    so no positional alignment survives outside a batch.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(element_type))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch_size):  # handed on batch by batch
                part = pdf.iloc[i:i + batch_size].copy()
                vectors = fn(part[text_col].tolist())
                if len(vectors) != len(part):
                    raise ValueError("embedder returned a different number of vectors")
                part[out_col] = pd.Series(vectors, index=part.index, dtype=object)
                yield part

    return df.mapInPandas(run, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, in DOUBLE."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return dot / (F.sqrt(na) * F.sqrt(nb))


# -------------------------------------------------------------------- top-k

AREA = 1 << 21  # scores that a task holds at once
HITS = 1 << 16  # pairs whose exact score is made at once


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(vectors.to_list()).astype(np.float64).reshape(-1, dim)


def _met(q: np.ndarray, m: np.ndarray, cell: np.ndarray, ids: np.ndarray, own: tuple | None, k: int, floor: np.ndarray, shape) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the k best rows of ``m`` for each row of ``q`` (-inf, -1: none).

    Only what scores ``floor`` or more counts; it rises with the k-th best found, and a
    cell (``m`` lies in their order) is met by the questions that it may serve
    better.  Products of four-byte numbers choose the pairs, their error bound
    included; what is chosen is scored exactly, alike for equal vectors.  ``ids``
    rank equal scores, ``own`` numbers both sides' ids if equal ones do not meet.
    """
    pivots, low, high = shape
    best, at, floor = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), floor.copy()
    qn, mn = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1))
    direction = q / qn[:, None]
    left, right = direction.astype(np.float32), (m / mn[:, None]).astype(np.float32)
    slack = (q.shape[1] + 8) * 2.0**-22
    spare = k + (np.unique(ids, return_counts=True)[1].max(initial=0) if own else 0)
    edge = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
    for start, end in zip(edge[:-1], edge[1:]):
        c = cell[start]
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (direction @ pivots[c])))
        reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(floor, -1.0))) + 1e-7
        reach[np.isneginf(floor)] = 3.0
        who = np.flatnonzero(np.maximum(d - high[c], low[c] - d) <= reach)
        for x in range(start, end, 1024):
            y = min(x + 1024, end)
            for w in np.split(who, range(AREA // 1024, len(who), AREA // 1024)):
                s = left[w] @ right[x:y].T
                bar = floor[w] - slack
                new = np.flatnonzero(np.isneginf(bar))
                if len(new) and y - x >= spare:  # nothing found yet: the block's own k-th
                    bar[new] = np.partition(s[new], y - x - spare, axis=1)[:, y - x - spare] - slack
                p, j = np.nonzero(s >= bar[:, None].astype(np.float32))
                p, j = w[p], j + x
                if own:
                    other = own[0][p] != own[1][j]
                    p, j = p[other], j[other]
                if not len(p):
                    continue
                exact = np.concatenate([(q[p[h : h + HITS]] * m[j[h : h + HITS]]).sum(1) for h in range(0, len(p), HITS)]) / (qn[p] * mn[j])
                good = exact >= floor[p]
                p, j, exact = p[good], j[good], exact[good]
                u, place = np.unique(p, return_inverse=True)
                row = np.concatenate([np.repeat(np.arange(len(u)), k), place])
                score, cand = np.concatenate([best[u].ravel(), exact]), np.concatenate([at[u].ravel(), j])
                order = np.lexsort((ids[cand], -score, row))
                row, score, cand = row[order], score[order], cand[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                kept = rank < k
                best[u[row[kept]], rank[kept]], at[u[row[kept]], rank[kept]] = score[kept], cand[kept]
                floor[u] = np.maximum(floor[u], best[u, k - 1])
    return best, at


def _score_block(k: int, dim: int, exclude_self: bool, shape, payload: list[str], only_floor: bool):
    """Top-k of some questions among some members; or just the k-th score, where there is one."""
    names = ["_q", "floor"] if only_floor else ["query_id", "cand_id", "score", *payload]

    def run(asked: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(cands):
            return pd.DataFrame({c: [] for c in names})
        cands = cands.sort_values("cell", kind="stable", ignore_index=True)
        ids = pd.factorize(cands["cand_id"], sort=True)[0]
        both = pd.factorize(pd.concat([asked["query_id"], cands["cand_id"]]))[0] if exclude_self else None
        own = (both[: len(asked)], both[len(asked) :]) if exclude_self else None
        floor = np.full(len(asked), -np.inf) if only_floor else asked["floor"].fillna(-np.inf).to_numpy(np.float64)
        q, m = _matrix(asked["vec"], dim), _matrix(cands["vec"], dim)
        best, at = _met(q, m, cands["cell"].to_numpy(), ids, own, k, floor, (shape[0].value, *shape[1:]))
        if only_floor:
            full = at[:, k - 1] >= 0
            return pd.DataFrame({"_q": asked["_q"].to_numpy()[full], "floor": best[full, k - 1]})
        p, r = np.nonzero(at >= 0)
        found = cands.iloc[at[p, r]]
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[p], "cand_id": found["cand_id"].to_numpy(), "score": best[p, r]} | {c: found[c].to_numpy() for c in payload})

    return run


def _usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Vectors that have a direction: ``dim`` finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0))


def _chords(vectors: pa.Array, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the pivots, a metric that falls as cosine rises."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, pivots.shape[1])
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * ((m / np.sqrt((m * m).sum(1))[:, None]) @ pivots.T)))


def _nearest_pivot(held, among: np.ndarray | None = None):
    """The nearest pivot (of those numbered ``among``) and its distance."""

    @F.arrow_udf("struct<cell:int,far:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        some = np.arange(len(held.value)) if among is None else among
        d = _chords(vectors, held.value[some])
        near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
        far = d[np.arange(len(d)), near]
        return pa.StructArray.from_arrays([pa.array(some[near], pa.int32()), pa.array(far, pa.float64())], ["cell", "far"])

    return nearest


def _needed(shape):
    """For mapInArrow: (grp, cell, met), the cells that may serve a group's questions
    better than their floor, and how many of them."""
    held, low, high = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            d = _chords(batch.column("vec"), held.value)
            floor = batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            reach = np.where(np.isneginf(floor), 3.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(floor, -1.0))) + 1e-7)
            need = np.maximum(d - high, low - d) <= reach[:, None]
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(grp).tolist():
                met[g] = met.get(g, 0) + need[grp == g].sum(0)
        for g, n in met.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g), pa.int32()), pa.array(cell, pa.int32()), pa.array(n[cell], pa.int64())], ["grp", "cell", "met"])

    return run


CELL = 1024  # rows of a cell, if there are pivots enough
MOST_PIVOTS = 4096


TILE = 16  # blocks of questions, and of members, that a task holds


@dataclass
class Cells:
    """A corpus cut into cells around pivots.

    ``rows`` has cand_id, vec, the payload, _row, cell and sub (parts of a cell of
    about ``block`` rows); ``sizes`` maps a cell to (rows, least, greatest
    distance to the pivot, parts).
    """

    rows: DataFrame
    pivots: object
    sizes: dict[int, tuple[int, float, float, int]]
    dim: int
    block: int

    @property
    def shape(self) -> tuple:
        """The pivots with the least and greatest distance of each one's members."""
        low, high = np.full(len(self.pivots.value), np.inf), np.full(len(self.pivots.value), -np.inf)
        for cell, (_, near, far, _) in self.sizes.items():
            low[cell], high[cell] = near, far
        return self.pivots, low, high


def _vectors(df: DataFrame, vec: str) -> Column:
    """Four-byte components stay so, others become double."""
    four = df.select(vec).schema[0].dataType == T.ArrayType(T.FloatType())
    return F.col(vec).cast("array<float>" if four else "array<double>").alias("vec")


def _useful(c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Without the copies of a vector that can be no question's k best: smaller ids
    come first, and at most k of a copy's rows share a question's id."""
    first = lambda d, most, *keys: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("cand_id"))).where(F.col("_n") <= most).drop("_n")
    return first(first(c, k, "vec", "cand_id"), 2 * k, "vec") if exclude_self else first(c, k, "vec")


def build_cells(corpus: DataFrame, cid: str, cvec: str, payload: list[str], dim: int | None, block: int, pivots: int | None, k: int, exclude_self: bool) -> Cells:
    """``pivots`` sampled vectors are broadcast and cells built around them; if not
    given, one for ``CELL`` rows, ``MOST_PIVOTS`` at most."""
    spark = corpus.sparkSession
    c = corpus.select(F.col(cid).alias("cand_id"), _vectors(corpus, cvec), *payload)
    if exclude_self:
        c = c.where(F.col("cand_id").isNotNull())
    if dim is None:
        dim = c.where(F.size("vec") > 0).agg(F.mode(F.size("vec"), True)).first()[0] or 1
    c = cut_lineage(_useful(_usable(c, "vec", dim), k, exclude_self).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    many = pivots or min(MOST_PIVOTS, max(1, c.count() // CELL))
    sample = c.orderBy(F.xxhash64("vec", "_row")).limit(many).select("vec").collect()
    points = np.array([r.vec for r in sample], np.float64).reshape(-1, dim)
    held = spark.sparkContext.broadcast(points / np.sqrt((points * points).sum(1))[:, None] if len(points) else np.ones((1, dim)))
    c = c.withColumn("_c", _nearest_pivot(held)("vec")).select("*", "_c.cell", "_c.far").drop("_c")
    c = cut_lineage(c, "cells")  # read for each pass
    found = c.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # a row a pivot
    sizes = {r.cell: (r.n, r.low, r.high, -(-r.n // block)) for r in found}
    rows = c.withColumn("sub", F.pmod(F.col("_row"), _of_cell({x: s[3] for x, s in sizes.items()})).cast("int")).drop("far")
    return Cells(rows, held, sizes, dim, block)


def _of_cell(table: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.lit(None).cast("map<int,int>"), F.col("cell"))


def _dealt(row: str, counts: dict[int, int], parts: int) -> Column:
    """Rows with a ``cell`` dealt evenly to parts, cell by cell; a large cell to several."""
    cells = sorted(counts)
    first = dict(zip(cells, np.cumsum([0, *(counts[c] for c in cells)]).tolist()))
    place = _of_cell({c: first[c] for c in cells}).cast("double") + F.pmod(F.xxhash64(row), _of_cell(counts))
    return F.least(F.floor(place * parts / max(1, sum(counts.values()))), F.lit(parts - 1)).cast("int")


def _floors(cells: Cells, asked: DataFrame, counts: dict[int, int], k: int, exclude_self: bool) -> DataFrame:
    """(_q, floor): a score that a question's k best reach, from its own cell's parts."""
    every = lambda table: F.explode(F.sequence(F.lit(0), _of_cell(table) - 1))
    groups = {c: -(-n // cells.block) for c, n in counts.items()}
    left = asked.select("_q", "query_id", "vec", "cell").withColumn("grp", F.pmod(F.xxhash64("_q"), _of_cell(groups)).cast("int"))
    left = left.withColumn("sub", every({c: s[3] for c, s in cells.sizes.items()}))
    right = cells.rows.select("cand_id", "vec", "cell", "sub").where(F.col("cell").isin(list(groups))).withColumn("grp", every(groups))
    score = _score_block(k, cells.dim, exclude_self, cells.shape, [], True)
    keys = ["cell", "sub", "grp"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: score(a, b), "_q long, floor double")
    return found.groupBy("_q").agg((F.max("floor") - 1e-12).alias("floor"))


def _tiles(questions: int, members: int, block: int, cores: int) -> tuple[int, int]:
    """How many groups of questions and slices of members: of at most ``TILE`` blocks
    each, and tiles enough for the cores while they hold more than a block."""
    side = TILE * block
    groups, slices = max(1, -(-questions // side)), max(1, -(-members // side))
    more = max(1.0, (4 * cores / (groups * slices)) ** 0.5)
    fit = lambda n, rows: max(n, min(int(np.ceil(n * more)), -(-rows // block)))
    return fit(groups, questions), fit(slices, members)


def topk_cosine(
    queries: DataFrame,
    qid: str,
    qvec: str,
    corpus: DataFrame,
    cid: str,
    cvec: str,
    k: int,
    dim: int | None = None,
    exclude_self: bool = False,
    payload: list[str] | None = None,
    block: int = 4096,
    pivots: int | None = None,
    report: dict | None = None,
) -> DataFrame:
    """Exact top-k by cosine: (query_id, rank, cand_id, score, *payload).

    The corpus is cut into cells around pivots.  On unit vectors the chord is a
    metric, so a question at distance d from a pivot is at least d - r from a
    member at distance r.  A question first meets the nearest cell that holds k
    members; its k-th score there bounds the rest, and only cells whose least
    possible distance does not exceed it are met.  Skipped cells cannot change
    the answer.

    The pairs are met in tiles of ``TILE`` blocks of questions by as many of members,
    both in the order of their cells.  A vector is sent once for a tile it is in, not
    for a cell: what is shuffled is the rows times the tiles of a side, which are
    a few up to millions of rows.

    Ids of any type; ties go to the smaller id.  ``dim`` is the vectors' dimension
    (the commonest of the corpus if not given); null, zero, non-finite and
    other vectors take no part.  ``report`` receives how many (question, cell)
    pairs there are and were met.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    payload = list(payload or [])
    cells = build_cells(corpus, cid, cvec, payload, dim, block, pivots, k, exclude_self)
    q = queries.select(F.col(qid).alias("query_id"), _vectors(queries, qvec))
    q = _usable(q.where(F.col("query_id").isNotNull()) if exclude_self else q, "vec", cells.dim)
    members = {c: s[0] for c, s in cells.sizes.items()}
    full = np.array(sorted(c for c, n in members.items() if n > k) or [0], np.int64)
    q = cut_lineage(q.withColumn("cell", _nearest_pivot(cells.pivots, full)("vec")["cell"]).withColumn("_q", F.monotonically_increasing_id()), "questions")
    counts = {r.cell: r.n for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    many = sum(counts.values())
    groups, slices = _tiles(many, sum(members.values()), block, q.sparkSession.sparkContext.defaultParallelism)
    asked = q.withColumn("grp", _dealt("_q", counts, groups)).drop("cell")
    if len(members) > 1:
        asked = cut_lineage(asked.join(_floors(cells, q, counts, k, exclude_self), "_q", "left"), "asked")
    else:  # nothing can be skipped
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    need = asked.select("grp", "vec", "floor").mapInArrow(_needed(cells.shape), "grp int, cell int, met long")
    need = cut_lineage(need.groupBy("grp", "cell").agg(F.sum("met").alias("met")), "needed")  # groups x cells at most
    if report is not None:
        report["pairs"], report["met"] = many * len(members), need.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0] + (many if len(members) > 1 else 0)
    right = cells.rows.drop("sub").withColumn("slice", _dealt("_row", members, slices)).join(F.broadcast(need.select("grp", "cell")), "cell").drop("_row")
    tiles = right.select(F.col("grp").alias("_g"), F.col("slice").alias("_s")).distinct()
    left = asked.join(F.broadcast(tiles), F.col("grp") == F.col("_g")).select("grp", F.col("_s").alias("slice"), "query_id", "vec", "floor")
    corpus = cells.rows
    schema = T.StructType(
        [T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("cand_id", corpus.schema["cand_id"].dataType), T.StructField("score", T.DoubleType())]
        + [corpus.schema[x] for x in payload]
    )
    score = _score_block(k, cells.dim, exclude_self, cells.shape, payload, False)
    keys = ["grp", "slice"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: score(a, b), schema)
    return _best(found, k, payload)


def _best(found: DataFrame, k: int, payload: list[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "cand_id", "score", *payload)


# ------------------------------------------------------------------- upsert

def latest_by_id(points: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per id: the greatest by ``order``, then by a hash of the row, so
    the choice never depends on the input's order.  A map-side combined
    aggregation; a hot id is no single task."""
    others = [c for c in points.columns if c != id_col]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*others).alias("_h"))
    best = points.groupBy(id_col).agg(F.max_by(F.struct(*others), rank).alias("_r"))
    return best.select(id_col, *[F.col("_r")[c].alias(c) for c in others])


def upsert(base: DataFrame, delta: DataFrame, id_col: str, version_col: str | None = None) -> DataFrame:
    """Insert or replace points by id: one row per id over both sides, the
    highest version; without versions, and among equal ones, ``delta`` wins."""
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.select(*base.columns).withColumn("_side", F.lit(1)))
    order = ([version_col] if version_col else []) + ["_side"]
    return latest_by_id(both, id_col, order).select(*base.columns)


def checked_points(points: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``points``, failing the write at the first vector of another dimension
    (null vectors pass: a point may have none)."""
    wrong = F.col(vec_col).isNotNull() & (F.size(vec_col) != dim)
    message = F.concat(F.lit(f"expected {dim} components, got "), F.size(vec_col).cast("string"))
    checked = F.when(wrong, F.raise_error(message).cast(points.schema[vec_col].dataType)).otherwise(F.col(vec_col))
    return points.withColumn(vec_col, checked)


def dimension_check(df: DataFrame, vec_col: str, dim: int) -> Column:
    """True where a vector has the wrong number of components."""
    return F.coalesce(F.size(vec_col), F.lit(-1)) != dim


def ensure_collection(spark, name: str, dim: int, schema: str | None = None) -> bool:
    """Create an empty point table if no table has exactly this name.

    Returns True when it was created.  The dimension is kept as the table
    property ``vector.dim``; ``append_points`` enforces it.
    """
    if spark.catalog.tableExists(name):
        return False
    schema = schema or "id string, vector array<float>, payload struct<page_content:string,metadata:map<string,string>>"
    spark.createDataFrame([], schema).write.saveAsTable(name)
    spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('vector.dim' = '{int(dim)}')")
    return True


def append_points(spark, name: str, points: DataFrame, vec_col: str = "vector") -> None:
    """Append to a table made by ``ensure_collection``, holding it to its dimension."""
    rows = spark.sql(f"SHOW TBLPROPERTIES `{name}` ('vector.dim')").collect()
    checked_points(points, vec_col, int(rows[0]["value"])).write.mode("append").saveAsTable(name)
