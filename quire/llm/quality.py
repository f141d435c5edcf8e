"""Document quality from a linear-chain CRF over lines.

Each line is a node with the hidden label good or bad.  Its emission score
is linear in features of the line and of both neighbouring lines; edges
score the label pair of neighbouring lines.  The chain is fitted by
conditional maximum likelihood on a bounded sample of labelled documents
(every line of a document carries the document's label).  A document's
quality is the mean of its lines' forward-backward marginals of "good",
weighted by line length, then calibrated on the same sample by a logistic
curve.

Features are counts over the bytes of a line, so whole batches are worked
on as flat arrays; the two passes of the chain run over all documents of a
batch at once.

*Defined results.*  Null and empty texts are one empty line.  Very long
texts and lines are used whole.  Repeated rows and null ids are scored like
any other row; null ids count as held out.  Without usable labels the score
is 0.5.  Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import logistic
from quire.llm.common import byte_view, col, fresh, held_out, steps
from quire.llm.sample import labelled_sample

LOWER, UPPER, DIGIT, SPACE, STOP, MARK, WIDE, KINDS = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = LOWER, UPPER, DIGIT, WIDE
    kind[[32, 9, 10, 11, 12, 13]] = SPACE
    kind[[ord(c) for c in ".,;:'\"-()?"]] = STOP
    return kind


KIND = _kinds()
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Chain:
    """Fitted parameters: feature scaling, emission weights, start and pair scores."""

    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray  # of [1, features of the line, its predecessor, its successor]
    start: np.ndarray  # log scores of (bad, good)
    pair: np.ndarray  # 2 x 2 log scores
    curve: np.ndarray  # logistic curve over the weighted marginal


def _spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line starts, ends and documents; every document has a line at least."""
    breaks = np.flatnonzero(raw == 10)
    doc = np.searchsorted(at, breaks, side="right") - 1
    starts = np.concatenate([at[:-1], breaks + 1])
    docs = np.concatenate([np.arange(len(at) - 1), doc])
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    last = np.append(docs[1:] != docs[:-1], True)
    ends = np.where(last, at[docs + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, docs


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes and its document."""
    starts, ends, docs = _spans(raw, at)
    n, size = len(starts), ends - starts
    if len(raw):
        breaks = np.zeros(len(raw), bool)
        breaks[ends[ends < len(raw)][raw[ends[ends < len(raw)]] == 10]] = True
        line = np.repeat(np.arange(n), np.diff(np.append(starts, len(raw))))
        counts = np.bincount(line * KINDS + KIND[raw], minlength=n * KINDS).reshape(n, KINDS)
        counts[:, SPACE] -= np.bincount(line[breaks], minlength=n)
        # words, and words equal to the one before them in their line
        space = KIND[raw] == SPACE
        begin = np.flatnonzero(~space & np.append(True, space[:-1] | (line[1:] != line[:-1])))
        stop = np.flatnonzero(~space & np.append(space[1:] | (line[1:] != line[:-1]), True)) + 1
        power = np.multiply.accumulate(np.full(len(raw), MIX))
        total = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power))
        code = (total[stop] - total[begin]) * power[len(raw) - 1 - begin]
        same = (code[1:] == code[:-1]) & (stop[1:] - begin[1:] == stop[:-1] - begin[:-1])
        of = line[begin] if len(begin) else np.zeros(0, np.int64)
        words = np.bincount(of, minlength=n)
        again = np.bincount(of[1:][same & (of[1:] == of[:-1])], minlength=n)
    else:
        counts, words, again = np.zeros((n, KINDS), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.maximum(size, 1)
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, WIDE]
    x = np.column_stack(
        [
            np.log1p(size),
            counts[:, UPPER] / np.maximum(letters, 1),
            counts[:, DIGIT] / full,
            counts[:, STOP] / np.maximum(words, 1),
            counts[:, MARK] / np.maximum(words, 1),
            np.log1p(size / np.maximum(words, 1)),
            again / np.maximum(words, 1),
            size == 0,
        ]
    )
    return x, size, docs


def _with_neighbours(x: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """[1, line, previous line, next line, is first, is last]; zeros beyond a document's ends."""
    same = docs[1:] == docs[:-1]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][same], after[:-1][same] = x[:-1][same], x[1:][same]
    first, last = np.append(True, ~same), np.append(~same, True)
    return np.column_stack([np.ones(len(x)), x, before, after, first, last])


def _blocks(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line and number of lines of each document, longest first."""
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    size = np.diff(np.append(first, len(docs)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], order


def marginals(score: np.ndarray, docs: np.ndarray, start: np.ndarray, pair: np.ndarray):
    """Forward-backward over all chains at once: P(good) of each line, the
    expected label pairs summed over all edges, and the summed log partition.

    ``score`` is each line's emission log-odds of good.  The step t of the
    loop handles line t of every document that has one, so the loop is as
    long as the longest document and its work is the number of lines.
    """
    first, size, _ = _blocks(docs)
    emit = np.column_stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))])
    move = np.exp(np.clip(pair, -30, 30))
    f, b = np.empty_like(emit), np.ones_like(emit)
    logz, steps_ = 0.0, int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps_), side="left")  # documents with more than t lines
    for t in range(steps_):
        i = first[: alive[t]] + t
        a = np.exp(start) * emit[i] if t == 0 else (f[i - 1] @ move) * emit[i]
        z = a.sum(1, keepdims=True)
        logz += float(np.log(z).sum())
        f[i] = a / z
    edges = np.zeros((2, 2))
    for t in range(steps_ - 2, -1, -1):
        i = first[: alive[t + 1]] + t
        right = emit[i + 1] * b[i + 1]
        v = right @ move.T
        b[i] = v / v.sum(1, keepdims=True)
        both = f[i][:, :, None] * move[None] * right[:, None, :]
        edges += (both / both.sum((1, 2), keepdims=True)).sum(0)
    p = f * b
    return p[:, 1] / p.sum(1), edges, logz


def fit_chain(x: np.ndarray, size: np.ndarray, docs: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Chain:
    """Conditional maximum likelihood by Adam steps; ``y`` is each document's label."""
    width = x.shape[1]
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    dim = 3 * width + 3
    theta = np.zeros(dim + 2 + 4)
    if len(y) and y.min() != y.max():
        z = _with_neighbours((x - mean) / std, docs)
        label = y[docs].astype(float)
        firsts = np.append(True, docs[1:] != docs[:-1])
        inner = ~firsts
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][inner[1:]].astype(int), label[1:][inner[1:]].astype(int)), 1)
        begin = np.bincount(label[firsts].astype(int), minlength=2)
        m, v, scale = np.zeros_like(theta), np.zeros_like(theta), 1.0 / len(x)
        for k in range(1, rounds + 1):
            start, pair = theta[dim : dim + 2], theta[dim + 2 :].reshape(2, 2)
            p, edges, _ = marginals(z @ theta[:dim], docs, start, pair)
            head = np.array([(1 - p[firsts]).sum(), p[firsts].sum()])
            g = np.concatenate([z.T @ (label - p), begin - head, (seen - edges).ravel()]) * scale - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    chain = Chain(mean, std, theta[:dim], theta[dim : dim + 2], theta[dim + 2 :].reshape(2, 2), np.zeros(2))
    chain.curve = logistic.fit(document_marginal(chain, x, size, docs, len(y))[:, None], y.astype(float))
    return chain


def document_marginal(chain: Chain, x: np.ndarray, size: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of P(good) over each document's lines."""
    if not n:
        return np.zeros(0)
    z = _with_neighbours((x - chain.mean) / chain.std, docs)
    p, _, _ = marginals(z @ chain.weight, docs, chain.start, chain.pair)
    w = np.maximum(size, 1).astype(float)
    return np.bincount(docs, p * w, n) / np.bincount(docs, w, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``rows`` labelled documents.  Line features are made on
    the executors; what reaches the driver is bounded by the sample."""
    sample = labelled_sample(docs, labels, label, rows, id_col=id_col, text_col=text_col)

    def features(batches):
        for batch in batches:
            raw, at = byte_view(batch.column(0))
            y = batch.column(1).to_pylist()
            for i, j in steps(at):
                x, size, doc = line_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(2).slice(i, j - i),
                        "y": pa.array(y[i:j], pa.int32()),
                        "x": pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        "size": pa.array([size[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    }
                )

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.select("text", "y", "id").mapInArrow(features, f"id {kind}, y int, x binary, size binary")
    got = sorted(got.collect(), key=lambda r: r["id"])
    size = [np.frombuffer(r["size"], "<i8") for r in got]
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = np.concatenate([np.frombuffer(r["x"], "<f4") for r in got]).reshape(-1, width).astype(float) if got else np.zeros((0, width))
    docs_ = np.repeat(np.arange(len(got)), [len(s) for s in size]) if got else np.zeros(0, np.int64)
    return fit_chain(x, np.concatenate(size) if got else np.zeros(0, np.int64), docs_, np.array([r["y"] for r in got], np.int64))


def score_column(chain: Chain, text):
    """Quality of each text as a double from 0 to 1."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        raw, at = byte_view(texts)
        out = []
        for i, j in steps(at):
            x, size, doc = line_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            out.append(logistic.apply(chain.curve, document_marginal(chain, x, size, doc, j - i)[:, None]))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return quality(text)


def classify(docs: DataFrame, labels: DataFrame, rows: int = 4000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every row."""
    chain = train(docs, labels, "quality", rows, id_col, text_col)
    out = docs.select(
        col(id_col).alias(id_col), held_out(col(id_col)).alias("held_out"), score_column(chain, col(text_col)).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = 4000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose quality reaches ``threshold``."""
    chain, score = train(docs, labels, "quality", rows, id_col, text_col), fresh(docs, "_quality")
    return docs.withColumn(score, score_column(chain, col(text_col))).where(col(score) >= threshold).drop(score)
