"""Periodic runs against a definition-by-definition search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import queries
from quire.llm.runs import Successor, find_runs, looped, periodic_runs, run_digest
from tests.conftest import SF_SMALL


def brute_runs(words, least=6):
    """All maximal stretches of every period, those kept whose smallest period it is."""
    out, n = [], len(words)
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.array([number[w] for w in words], np.int64)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        turns = np.flatnonzero(np.diff(same))
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if j + q - i >= max(least, 4 * q):
                part = ids[i : j + q]
                if not any((part[d:] == part[:-d]).all() for d in range(1, q)):
                    out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words):
    numbered = {w: i for i, w in enumerate(sorted(set(words)))}
    ids = np.array([*(numbered[w] for w in words), len(numbered)], np.int64)
    return list(zip(*(x.tolist() for x in find_runs(ids))))


def grown(rnd):
    """Words with nested and neighbouring repetitions."""
    words = [rnd.choice("abc") for _ in range(rnd.randint(0, 12))]
    for _ in range(rnd.randint(1, 4)):
        i = rnd.randint(0, len(words))
        j = rnd.randint(i, min(len(words), i + rnd.choice([1, 2, 3, 5, 9, 17])))
        words[i:j] = (words[i:j] * rnd.randint(2, 7))[: rnd.randint(j - i, 60)]
        words = words[:160]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_all_runs_are_found(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        words = grown(rnd)
        assert runs_of(words) == brute_runs(words), words


def test_runs_of_every_period():
    for q in [*range(1, 40), 63, 64, 65, 85, 86, 128, 171]:
        for extra in (0, 1, q - 1):
            for lead in (0, 1, 5, 8):
                unit = [f"u{i}" for i in range(q)]
                words = [f"l{i}" for i in range(lead)] + (unit * 9)[: max(6, 4 * q) + extra] + ["end"]
                assert (lead, max(6, 4 * q) + extra, q) in runs_of(words)
    assert runs_of(["a"] * 5) == [] and runs_of(["a"] * 6) == [(0, 6, 1)]
    assert runs_of(list("abcabcabcab")) == []


def test_fibonacci_and_powers():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    for words in (b, b * 5, ("a" * 9 + "b") * 12, "ab" * 7 + "c" + "ab" * 9, ("aab" * 5 + "c") * 5):
        assert runs_of(list(words)[:400]) == brute_runs(list(words)[:400])


def test_range_successor():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 500):
        values = rnd.permutation(n).astype(np.int64)
        lo = rnd.integers(0, n, 300)
        hi = np.minimum(n, lo + rnd.integers(0, n, 300))
        x = rnd.integers(0, n + 2, 300)
        got = Successor(values).at_least(lo, hi, x)
        for g, a, b, v in zip(got.tolist(), lo.tolist(), hi.tolist(), x.tolist()):
            right = [w for w in values[a:b].tolist() if w >= v]
            assert g == (min(right) if right else np.iinfo(np.int64).max)


def loop_words(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r[0]: tuple(r[1:]) for r in queries.op11_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) > 5
    for r in docs:
        assert got[r.doc_id] == digest(loop_words(r.text.encode().split(), r.doc_id)), r.doc_id


def test_steps_do_not_matter(spark):
    docs = looped(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    runs = lambda words: sorted((r.id, str(r.found)) for r in periodic_runs(docs, step_words=words).collect())
    assert runs(1) == runs(1 << 17)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "ja " * 9), (4, "ja " * 9), (None, "x y x y x y x y"), (5, "a b c " * 40_000 + "d"), (6, "w  " * 6), (7, "x y " * 3)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, found int, runs string")
    got = run_digest(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    empty = hashlib.sha256(b"").hexdigest()
    by = sorted(map(tuple, got.collect()), key=str)
    assert len(by) == len(rows)
    assert (1, 0, None, None, None, None, empty, empty) in by and (3, 0, None, None, None, None, empty, empty) in by
    assert sum(r[:6] == (4, 1, 0, 9, 1, 9000) for r in by) == 2
    assert any(r[:6] == (None, 1, 0, 8, 2, 4000) for r in by)
    assert any(r[:6] == (5, 1, 0, 120_000, 3, 40_000_000) and r[7] == hashlib.sha256(b"a b c d").hexdigest() for r in by)
    assert any(r[:6] == (6, 1, 0, 6, 1, 6000) for r in by) and any(r[:2] == (7, 0) for r in by)
    assert run_digest(docs.limit(0)).collect() == []
    assert {r.collapsed for r in periodic_runs(docs).select("found.collapsed").collect() if "ja" in r.collapsed} == {"ja"}


def test_looped_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    texts = {i: "  one two\tthree four\nfive six " * (1 + i % 5) for i in ids} | {ids[0]: "", ids[1]: " "}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "a b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in looped(docs).withColumnRenamed("text", "t").collect()}
    assert got.pop(None) == "a b" and got.pop(3) is None
    assert {i: t.split() for i, t in got.items()} == {i: loop_words(t.split(), i) for i, t in texts.items()}
