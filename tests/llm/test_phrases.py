"""Collocations against counting every phrase in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import phrases, queries
from quire.llm.phrases import collocations, exact_score, merge, pair_code, pair_of, tiled, windows
from tests.conftest import SF_SMALL


def brute(rows, least=10, max_words=3, share=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for m in range(1, max_words + 1):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()) if len(often) < 3000 else inside(often, p, a, share):
                continue
            score, k = min((10**6 * a * a // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def inside(often, p, a, share, _made={}):
    if id(often) not in _made:
        most = Counter()
        for q, b in often.items():
            for m in range(1, len(q)):
                for i in range(len(q) - m + 1):
                    most[q[i : i + m]] = max(most[q[i : i + m]], b)
        _made[id(often)] = (often, most)
    return 100 * _made[id(often)][1][p] >= share * a


def rows_of(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_query_equals_counting(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = brute([(r.lang, r.text) for r in docs])
    assert len(want) > 100 and rows_of(queries.op12_collocations(spark, SF_SMALL)) == want


@pytest.mark.parametrize("max_words,chunk", [(2, 7), (3, 1 << 19), (3, 5), (4, 11)])
def test_small_chunks_lose_nothing(spark, max_words, chunk):
    rnd = random.Random(max_words * chunk)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n"]
    vocab = ["a", "B", "c", "Dé", "é", "New", "York", "City", "x\x0ey", "漢字"]
    rows = []
    for _ in range(60):
        text = "".join(rnd.choice(vocab) + rnd.choice(ends) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "fr", None, "und"]), text + "new york city " * rnd.randint(0, 2)))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(collocations(docs, least=4, max_words=max_words, chunk_words=chunk))
    assert got == brute(rows, least=4, max_words=max_words)


def test_ties_and_limits(spark):
    rows = [("en", f"{x} {y}. " * 10) for x in "abcdef" for y in "ghijkl"]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(collocations(docs, top=7))
    assert got == brute(rows, top=7) and sorted(r[2] for r in got) == ["a g", "a h", "a i", "a j", "a k", "a l", "b g"]
    assert rows_of(collocations(docs, least=11)) == set()


def test_edge_rows(spark):
    long = "red green blue " * 60_000
    rows = [(1, None, None), (2, "", "en"), (3, " .,\t", "en"), (4, long, "en"), (4, "red green", "en"), (4, "red green", "en"), (None, "w" * 700_000 + " w w", "en"), (5, "Au Au " * 9, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, a int, chunk string")
    got = rows_of(collocations(docs))
    assert got == brute([(r[2], r[1]) for r in rows]) and {r[0] for r in got} == {"en", "und"}
    assert collocations(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations(docs, max_words=1)


def test_scores_are_exact(spark):
    a = [10, 999_999_999_999_999, 123_456_789_012_345, 7, 3_037_000_500]
    rows = [(x, x + d, x + e) for x in a for d in (0, 1, 5) for e in (0, 3)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", exact_score(df.a, df.l, df.r).alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got) and len(got) == len(rows)


def test_tiles():
    rnd = np.random.default_rng(1)
    first = np.concatenate([rnd.integers(1, 900, 200_000), rnd.integers(1, 1 << 33, 5000)])
    word = np.concatenate([rnd.integers(1, 900, 200_000), rnd.integers(1, 1 << 30, 5000)])
    code = pair_code(first, word)
    assert all((x == y).all() for x, y in zip(pair_of(code), (first, word)))
    got, counts = tiled(code)
    want, n = np.unique(code, return_counts=True)
    assert merge([got], [counts])[0].tolist() == want.tolist() and merge([got], [counts])[1].tolist() == n.tolist()
    halves = merge([got, got[:9]], [counts, counts[:9]])
    assert halves[1].sum() == n.sum() + counts[:9].sum()
    with pytest.raises(ValueError):
        pair_code(np.array([1 << 33]), np.array([1]))


def test_windows_cut_between_words():
    data = b"one two\nthree" + b"x" * 50 + b" four  five\n\n"
    for size in range(1, 30):
        parts = list(windows(data, size))
        assert b"".join(parts) == data
        assert [w for p in parts for w in p.replace(b"\n", b" ").split()] == data.replace(b"\n", b" ").split()


def test_merging_in_steps(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    rnd = np.random.default_rng(2)
    ids = rnd.integers(0, 40, (30, 80))
    rows = [{"chunk": i, "lang": "en" if i % 3 else "fr", "skip": 0, "words": x.astype("<i4").tobytes(), "firsts": x.tobytes() if i % 2 else None} for i, x in enumerate(ids)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 4]) for i in range(0, 30, 4)]
    sent = pa.Table.from_batches(phrases._partial(3, False)(batches)).sort_by([("lang", "ascending"), ("bucket", "ascending")])
    assert sent.num_rows > 20  # several partial counts a bucket
    got = pa.Table.from_batches(phrases._merged(5)(sent.to_batches(7))).to_pylist()
    want = Counter((r["lang"], int(a), int(b)) for r, x in zip(rows, ids) for a, b in zip(x, x[1:]) if a and b)
    assert {(r["lang"], r["i"], r["j"]): r["a"] for r in got} == {k: n for k, n in want.items() if n >= 5}
