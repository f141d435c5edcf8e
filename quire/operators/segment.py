"""Word segmentation with a lexicon table.

A run of letters and digits is cut into lexicon words so that the sum of their
costs is least (unigram model, Viterbi path); a character that no word covers
stands alone at ``unknown`` cost.  Ties go to the longer last word.

*Plan.*  The substrings of a run, up to the longest lexicon word, meet the
lexicon: the hits are the edges of the run's word lattice.  A lexicon of up to
``SMALL_WORDS`` goes to the tasks, which cut a batch's distinct runs where they
lie: no row is written or shuffled.  A larger one meets the substrings of all
distinct runs in a join, so it may have any size.  The lattice of a run is one
row, its best path is found in Arrow batches, and the parts come back to the
texts like any word's value (``operators.lookup``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import lookup as L
from quire.session import cut_lineage

SMALL_WORDS, SMALL_CHARS = 500_000, 1 << 23  # a lexicon up to these goes to the tasks
RUN_PATTERN = r"[\p{L}\p{N}]+"


def runs(text: Column) -> Column:
    """The runs of letters and digits of a text."""
    return F.regexp_extract_all(text, F.lit(RUN_PATTERN), 0)


def unigram_lexicon(df: DataFrame, tokens_col: str, least: int, longest: int) -> DataFrame:
    """(word, cost): tokens of up to ``longest`` characters that stand ``least``
    times; the cost is floor(log2(2 N / n)) for n of N tokens, plus one a word."""
    tokens = df.select(F.explode(tokens_col).alias("word"))
    counts = cut_lineage(tokens.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where((F.col("n") >= least) & (F.length("word") <= longest))
    return kept.select("word", (F.length(F.bin(F.expr(f"{total}L div n"))) + 1).cast("int").alias("cost"))


def best_path(run: str, edges: list[tuple[int, int, int]], unknown: int) -> list[str]:
    """The cheapest cut of a run; edges are (start, end, cost)."""
    ending: list[list[tuple[int, int]]] = [[] for _ in range(len(run) + 1)]
    for start, end, cost in edges:
        ending[end].append((cost, start))
    cost, back = [0] * (len(run) + 1), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        cost[end], back[end] = min([(cost[s] + c, s) for c, s in ending[end]] + [(cost[end - 1] + unknown, end - 1)])
    parts, end = [], len(run)
    while end:
        parts.append(run[back[end] : end])
        end = back[end]
    return parts[::-1]


def _paths(unknown: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def paths(run: pa.Array, edges: pa.Array) -> pa.Array:
        rows = zip(run.to_pylist(), edges.to_pylist())
        return pa.array([best_path(r, [(e["a"], e["b"], e["cost"]) for e in es or ()], unknown) for r, es in rows], pa.list_(pa.string()))

    return paths


def _cuts(cost: dict[str, int], unknown: int, longest: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cuts(runs: pa.Array) -> pa.Array:
        """The parts of each row's runs; each distinct run of a batch is cut once."""
        each = runs.flatten().dictionary_encode()
        cut = []
        for r in each.dictionary.to_pylist():
            spans = [(a, b) for a in range(len(r)) for b in range(a + 1, min(len(r), a + longest) + 1)]
            cut.append(best_path(r, [(a, b, cost[r[a:b]]) for a, b in spans if r[a:b] in cost], unknown))
        cut.append([])  # of a null
        parts = L._strings(cut).take(each.indices.fill_null(len(cut) - 1))
        ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
        rows = np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        nulls = np.concatenate([[0], np.cumsum(each.indices.is_null().to_numpy(zero_copy_only=False))])
        # a row with a null run has no parts
        return pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), parts.flatten(), mask=pa.array(np.diff(nulls[rows]) > 0))

    return cuts


def segmented(words: DataFrame, lexicon: DataFrame, unknown: int, longest: int) -> DataFrame:
    """(word, value) for the distinct ``word`` rows: the parts of each."""
    small = L.small_table(lexicon.select("word", F.col("cost").alias("value")))
    if small is not None:
        cost = dict(zip(small["word"].to_pylist(), small["value"].to_pylist()))
        return words.select("word", _cuts(cost, unknown, longest)(F.array("word")).alias("value"))
    ends = lambda a: F.sequence(a + 1, F.least(F.length("word"), a + longest))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda a: F.transform(ends(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    parts = words.where(F.length("word") > 0).select("word", F.explode(spans).alias("s"))
    parts = parts.select(F.col("word").alias("run"), "s.a", "s.b", F.expr("substring(word, s.a + 1, s.b - s.a)").alias("word"))
    edges = parts.join(lexicon, "word").groupBy(F.col("run").alias("word")).agg(F.collect_list(F.struct("a", "b", "cost")).alias("edges"))
    # runs without any lexicon word are their characters
    rows = words.join(edges, "word", "left")
    return rows.select("word", _paths(unknown)(F.col("word"), F.col("edges")).alias("value"))


def segment_df(df: DataFrame, tokens_col: str, lexicon: DataFrame, out_col: str = "words", unknown: int = 64) -> DataFrame:
    """Adds ``out_col``: the runs of ``tokens_col`` cut into lexicon words.

    ``lexicon`` has one row (word, cost) a word, costs being whole numbers.
    Rows may repeat; a null or empty array gives an empty one.
    """
    kept = df.columns
    longest = lexicon.agg(F.max(F.length("word"))).first()[0] or 1
    small = L.small_table(lexicon.select("word", F.col("cost").alias("value")), SMALL_WORDS, SMALL_CHARS)
    if small is not None:
        cost = dict(zip(small["word"].to_pylist(), small["value"].to_pylist()))
        return df.select(*kept, _cuts(cost, unknown, longest)(F.col(tokens_col)).alias(out_col))
    rows = L.numbered(df, L.coded(F.col(tokens_col)).alias("_coded"))
    distinct = L.pairs(rows, F.col("_coded.words")).select("word").distinct()
    table = cut_lineage(segmented(distinct, lexicon, unknown, longest), "segmented")
    rows = L.hits(rows, F.col("_coded.words"), table, "_hits")
    parts = L.per_token(F.col("_hits"), F.col("_coded.codes"), T.ArrayType(T.StringType()))
    return rows.select(*kept, F.flatten(parts).alias(out_col))
