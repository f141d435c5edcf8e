"""Toxicity from two class-conditional Kneser-Ney models.

One character model is learnt from toxic and one from ordinary labelled
texts.  A text's evidence is the difference of its two log-likelihoods,
normalised by length: over the whole text and over its strongest window.
A logistic curve fitted on labelled rows that the models have not seen
turns both into a score.

*Symbols.*  UTF-8 bytes after lower-casing A-Z, mapped onto 64 symbols:
the letters, a digit, a separator, and 36 for the bytes of other scripts.

*Models.*  Interpolated Kneser-Ney over symbols.  The longest order counts
the class's texts that hold an n-gram (so one repetitive text weighs no
more than another); the shorter order counts distinct left contexts within
the class.  Below that both classes share one backoff: the
distinct left contexts of trigrams and the frequencies counted over all
documents, labelled or not.  An expression that neither class has seen
therefore gets the same probability from both and carries no evidence, and
one that a single class has seen is weighed against the shared backoff.

*Plan.*  The labelled rows are a bounded sample (``rows``).  Their n-grams
are counted per task and summed by Spark; the number of distinct n-grams is
bounded by the sample, so the model is small enough to broadcast.  Shared
counts come from one pass over all documents: each task holds one array of
2^18 trigram counts and Spark sums the arrays' rows.  Scoring is a second,
narrow pass.

*Defined results.*  Null and empty texts have no evidence and get the
curve's value at zero.  Long texts are scored whole.  Repeated rows, null
ids and tables without usable labels are fine (the score is then the
smoothed rate of the labels).  Only id and text are read; labels, language,
source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import logistic
from quire.llm.common import byte_view, col, held_out, steps
from quire.llm.sample import labelled_sample

ORDER = 5
SHARED = 3  # orders up to this one are shared by the classes
WIDTH = 6  # bits of a symbol
SEPARATOR, DIGIT, OTHER = 0, 27, 28
WINDOW = 24  # symbols in the window that is looked for


def _symbols() -> np.ndarray:
    table = np.full(256, SEPARATOR, np.uint64)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[48:58] = DIGIT
    table[128:] = OTHER + np.arange(128) % 36
    return table


SYMBOL = _symbols()


def _codes(s: np.ndarray, order: int) -> np.ndarray:
    """The code of the n-gram that ends at each position from order - 1 on."""
    if len(s) < order:
        return np.zeros(0, np.uint64)
    n, out = len(s) - order + 1, np.zeros(len(s) - order + 1, np.uint64)
    for k in range(order):
        out = (out << np.uint64(WIDTH)) | s[k : k + n]
    return out


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ORDER - 1 separators before it, and the
    text's offsets in them; so no n-gram that ends in a text reaches another."""
    size = np.diff(at)
    off = np.append(0, np.cumsum(size + ORDER - 1))
    out = np.zeros(off[-1], np.uint64)
    out[np.arange(len(raw)) + np.repeat((ORDER - 1) * np.arange(1, len(size) + 1), size)] = SYMBOL[raw]
    return out, off


def _own(off: np.ndarray, total: int) -> np.ndarray:
    """Marks the positions that belong to a text, not to its padding."""
    own = np.ones(total, bool)
    for k in range(ORDER - 1):
        own[off[:-1] + k] = False
    return own


def count_sample(batches):
    """Per task: the n-grams of the sample with the number of texts of each class that hold them."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        g = np.concatenate([p[0] for p in parts])
        keys, back = np.unique(g, return_inverse=True)
        return keys, *(np.bincount(back, np.concatenate([p[k] for p in parts]), len(keys)) for k in (1, 2))

    for batch in batches:
        raw, at = byte_view(batch.column(0))
        y = np.asarray(batch.column(1).to_pylist(), np.int64)
        for i, j in steps(at):
            s, off = _padded(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            own = _own(off, len(s))[ORDER - 1 :]
            text = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(off))[ORDER - 1 :]
            bits = np.uint64(ORDER * WIDTH)
            pairs = np.unique(_codes(s, ORDER)[own] | text[own] << bits)  # once per text
            t = y[i:j][(pairs >> bits).astype(np.int64)]
            keys, back = np.unique(pairs & ((np.uint64(1) << bits) - np.uint64(1)), return_inverse=True)
            ones = np.bincount(back, t, len(keys))
            parts.append((keys, ones, np.bincount(back, minlength=len(keys)) - ones))
        if len(parts) > 8:
            parts = [merged()]
    if parts:
        g, toxic, plain = merged()
        for i in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_pydict(
                {
                    "g": pa.array(g[i : i + (1 << 16)].astype(np.int64)),
                    "toxic": pa.array(toxic[i : i + (1 << 16)].astype(np.int64)),
                    "plain": pa.array(plain[i : i + (1 << 16)].astype(np.int64)),
                }
            )


def count_corpus(batches):
    """Per task: counts of all trigrams of all texts."""
    total = np.zeros(1 << (SHARED * WIDTH), np.int64)
    for batch in batches:
        raw, at = byte_view(batch.column(0))
        for i, j in steps(at):
            s, off = _padded(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            own = _own(off, len(s))[SHARED - 1 :]
            total += np.bincount(_codes(s, SHARED)[own].astype(np.int64), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"g": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


@dataclass
class Model:
    """Log-likelihood ratios of the n-grams of each class order, and of the
    weights with which a seen context backs off."""

    ratio: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # order: n-gram + 1 (or 0), value by slot
    backoff: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))


def shared_backoff(trigrams: np.ndarray, discount: float = 0.75) -> np.ndarray:
    """P(symbol | two symbols) as a flat table, from corpus trigram counts:
    interpolated Kneser-Ney whose lower orders count distinct left contexts."""
    k = 1 << WIDTH
    n3 = trigrams.reshape(k, k, k).astype(float)
    n2 = (n3 > 0).sum(0).astype(float)  # left contexts of each pair
    n1 = (n2 > 0).sum(0).astype(float)
    p = (n1 + 1.0) / (n1.sum() + k)
    for counts in (n2, n3):
        total = counts.sum(-1, keepdims=True)
        kinds = (counts > 0).sum(-1, keepdims=True)
        lower = np.broadcast_to(p, counts.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(total > 0, (np.maximum(counts - discount, 0) + discount * kinds * lower) / total, lower)
    return p.reshape(-1)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hashed table of all keys, at most half full: a key whose slot is taken
    stands in the next free one.  Slots hold the whole key (30 bits) plus one."""
    size = 1 << max(4, (2 * len(keys)).bit_length())
    tags, out = np.zeros(size, np.uint32), np.zeros(size, np.float32)
    slot, tag, todo = _slots(keys, size), (keys + np.uint64(1)).astype(np.uint32), np.arange(len(keys))
    while len(todo):
        free = todo[tags[slot[todo]] == 0]
        won = free[np.unique(slot[free], return_index=True)[1]]
        tags[slot[won]], out[slot[won]] = tag[won], values[won]
        todo = todo[tags[slot[todo]] != tag[todo]]
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return tags, out


def _find(tags: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each key, and whether the table holds it."""
    slot, tag = _slots(keys, len(tags)), (keys + np.uint64(1)).astype(np.uint32)
    seen = tags[slot]
    hit = seen == tag
    todo = np.flatnonzero(~hit & (seen != 0))
    while len(todo):
        slot[todo] = (slot[todo] + 1) & (len(tags) - 1)
        seen = tags[slot[todo]]
        hit[todo] = seen == tag[todo]
        todo = todo[(seen != tag[todo]) & (seen != 0)]
    return slot, hit


def kneser_ney(g: np.ndarray, toxic: np.ndarray, plain: np.ndarray, shared: np.ndarray, discount: float = 0.9) -> Model:
    """Both class models over the sample's n-grams ``g``; ``shared`` is the backoff."""
    w, model = np.uint64(WIDTH), Model()
    chain = [(g, np.column_stack([toxic, plain]).astype(float))]
    for order in range(ORDER - 1, SHARED, -1):  # distinct left contexts per class
        longer, counts = chain[0]
        keys, back = np.unique(longer & np.uint64((1 << (order * WIDTH)) - 1), return_inverse=True)
        chain.insert(0, (keys, np.column_stack([np.bincount(back, counts[:, c] > 0, len(keys)) for c in (0, 1)])))
    lower_keys, lower = None, None
    for order, (keys, counts) in enumerate(chain, SHARED + 1):
        suffix = keys & np.uint64((1 << ((order - 1) * WIDTH)) - 1)
        if lower_keys is None:
            base = np.repeat(shared[suffix.astype(np.int64)][:, None], 2, 1)
        else:
            base = lower[np.searchsorted(lower_keys, suffix)]
        ctx, back = np.unique(keys >> w, return_inverse=True)
        p, loose = np.empty((len(keys), 2)), np.ones((len(ctx), 2))
        for c in (0, 1):
            total = np.bincount(back, counts[:, c], len(ctx))
            kinds = np.bincount(back, counts[:, c] > 0, len(ctx))
            loose[:, c] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(counts[:, c] - discount, 0) / np.maximum(total[back], 1)
            p[:, c] = own + loose[back, c] * base[:, c]
        model.ratio[order] = _table(keys, np.log(p[:, 0]) - np.log(p[:, 1]))
        model.backoff[order] = _table(ctx, np.log(loose[:, 0]) - np.log(loose[:, 1]))
        lower_keys, lower = keys, p
    return model


def evidence(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: the length-normalised log-likelihood ratio of the whole text
    and of its strongest window, and the logarithm of its length."""
    s, off = _padded(raw, at)
    size, x = np.diff(at), np.zeros((len(at) - 1, 3))
    if not len(s):
        return x
    ratio = np.zeros(len(s), np.float32)
    for order in range(SHARED + 1, ORDER + 1):
        code = _codes(s, order)
        if not len(code):
            break
        here = ratio[order - 1 :]
        tags, values = model.backoff[order]
        slot, hit = _find(tags, code >> np.uint64(WIDTH))
        here += np.where(hit, values[slot], np.float32(0))
        tags, values = model.ratio[order]
        slot, hit = _find(tags, code)
        np.copyto(here, values[slot], where=hit)
    ratio[~_own(off, len(s))] = 0
    total = np.append(0.0, np.cumsum(ratio, dtype=np.float64))
    x[:, 0] = (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)
    # windows that end in a text and start in it; a shorter text is one window
    end = np.arange(1, len(s) + 1)
    start = np.maximum(end - WINDOW, np.repeat(off[:-1], np.diff(off)))
    most = np.maximum.reduceat(total[1:] - total[start], off[:-1])
    x[:, 1] = np.where(size > 0, most, 0.0) / WINDOW
    x[:, 2] = np.log1p(size)
    return x


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows`` labelled texts: three quarters of them (by hash of
    the id) for the models, the rest for the curve."""
    sample = labelled_sample(docs, labels, label, rows, id_col=id_col, text_col=text_col)
    for_curve = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(4)) == 0
    grams = sample.where(~for_curve).select("text", "y").mapInArrow(count_sample, "g long, toxic long, plain long")
    grams = grams.groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).toPandas()
    grams = grams.sort_values("g")
    corpus = docs.select(col(text_col)).mapInArrow(count_corpus, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    corpus = corpus.toPandas()  # at most 2^18 rows
    trigrams = np.zeros(1 << (SHARED * WIDTH))
    trigrams[corpus["g"].to_numpy(np.int64)] = corpus["n"].to_numpy(float)
    g = grams["g"].to_numpy(np.int64).astype(np.uint64)
    model = kneser_ney(g, grams["toxic"].to_numpy(float), grams["plain"].to_numpy(float), shared_backoff(trigrams))

    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            raw, at = byte_view(batch.column(0))
            for i, j in steps(at):
                x = evidence(held.value, raw[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_pydict(
                    {"y": batch.column(1).slice(i, j - i), **{f"x{k}": pa.array(x[:, k]) for k in range(x.shape[1])}}
                )

    seen = sample.where(for_curve).select("text", "y").mapInArrow(measure, "y int, x0 double, x1 double, x2 double")
    seen = seen.toPandas().sort_values(["y", "x0", "x1", "x2"])
    model.curve = logistic.fit(seen[["x0", "x1", "x2"]].to_numpy(float), seen["y"].to_numpy(float))
    return model


def score_column(spark, model: Model, text):
    """Toxicity of each text as a double from 0 to 1.  The model's tables hold the
    n-grams of a bounded sample, so they may be broadcast."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        raw, at = byte_view(texts)
        out = [logistic.apply(held.value.curve, evidence(held.value, raw[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in steps(at)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return toxicity(text)


def classify(docs: DataFrame, labels: DataFrame, rows: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every row."""
    model = train(docs, labels, "toxic", rows, id_col, text_col)
    out = docs.select(
        col(id_col).alias(id_col),
        held_out(col(id_col)).alias("held_out"),
        score_column(docs.sparkSession, model, col(text_col)).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
