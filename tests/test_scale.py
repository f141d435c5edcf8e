"""What a task holds does not grow with the matches, pairs or batches it sees."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.operators import lookup as L
from quire.operators import rank as RK
from quire.operators import replace as RP
from quire.operators import rouge as R
from quire.operators import vector as V
from quire.plans.cleaning import subword_codec


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_of_several_blocks_stay_in_the_task(spark):
    lexicon = {"ab": "1", "abc": "22", "bcd é": "3", "甲乙": "", "d": "dd"}
    table = spark.createDataFrame(list(lexicon.items()), "source string, target string")
    texts = ["xabcd é", None, "", "abab 甲乙d", "é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = RP.replace_phrases(df, "text", table, block_chars=4)
    assert _plan(out).count("ArrowEvalPython") == 1 and "_matches" not in _plan(out)
    assert [r.text for r in out.orderBy("id").collect()] == ["x22dd é", None, "", "11 dd", "é" * 50]


def test_slices_and_blocks_against_regular_expressions(monkeypatch):
    monkeypatch.setattr(RP, "SLICE", 60)
    monkeypatch.setattr(RP, "COMPARED", 7)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé甲 \0") for _ in range(n))
    for _ in range(50):
        lexicon = {word(rng.randint(1, 6)): f"<{i}>" for i in range(9)}
        texts = [word(rng.randint(0, 90)) for _ in range(6)] + [None]
        pattern = re.compile("|".join(map(re.escape, sorted(lexicon, key=len, reverse=True))))
        items = list(lexicon.items())
        found = [RP.Block(pa.array([a for a, _ in part]), pa.array([b for _, b in part])) for part in (items[:3], items[3:]) if part]
        got = list(texts)
        for mine in RP.slices(texts):
            assert len(mine) == 1 or sum(len(texts[i]) for i in mine) <= 60
            for i, text in zip(mine, RP.replaced([texts[i] for i in mine], found)):
                got[i] = text
        assert got == [None if t is None else pattern.sub(lambda m: lexicon[m[0]], t) for t in texts]


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_both_columns_are_cleaned(spark, tmp_path):
    d = _documents(spark, tmp_path, [(1, "One, TWO!\nThree.", "en", "a", 16), (2, None, "en", "a", 0)])
    rows = E.queries()["clean_text"](spark, d).collect()
    assert [r.asDict() for r in rows] == [{"doc_id": 1, "text": "one two three", "summary": "one two"}]


def test_every_document_becomes_a_point(spark, tmp_path):
    d = _documents(spark, tmp_path, [(1, "a b", "en", "s", 3), (2, "c", None, None, 1), (3, None, "en", "s", 0)])
    vectors = [(1, [1.0, 2.0], 0), (9, [3.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    got = {r.id: (r.page_content, r.text, r.dim) for r in E.queries()["jsonl_roundtrip"](spark, d).collect()}
    assert got == {"1": ("a b", "a b", 2), "2": ("c", "c", 64), "3": (None, None, None), "9": (None, None, 1)}


def test_outputs_are_folded_once(spark):
    docs = spark.createDataFrame([(1, "A court ruled. A river ran."), (2, "")], "doc_id long, text string")
    out = RK.ranked_outputs(docs).where(F.size("outputs") > 0)
    assert _plan(out).count("folded(") == 1 and [r.doc_id for r in out.collect()] == [1]


def test_ids_used_twice_are_made_once(spark):
    codec = subword_codec()
    ids = spark.createDataFrame([("a b",), (None,)], "t string").select(codec.encode_column(F.col("t")).alias("ids"))
    out = ids.select(codec.decode_column(F.col("ids")).alias("t"), F.size("ids").alias("n"))
    assert _plan(out).count("encode(t") == 1
    assert [r.t for r in out.collect()] == ["a b", None]


def test_pairs_make_no_row_per_gram(spark):
    rows = [(1, ["a", "a", "b"], ["a", "b"]), (1, ["b"], ["b", "b"]), (2, None, ["a"]), (None, [], [])]
    df = spark.createDataFrame(rows, "k int, c array<string>, r array<string>")
    out = R.rouge_n_pairs(df, ["k"], "c", "r", (1, 2))
    assert "collect_list" in _plan(out) and _plan(out).count("Generate") == 1
    assert sorted((r.k or 0, r.n, r.match, r.cand_total, r.ref_total) for r in out.collect()) == [(0, 1, 0, 0, 0), (0, 2, 0, 0, 0), (1, 1, 3, 4, 4), (1, 2, 1, 2, 2)]


def test_slices_hold_few_values(monkeypatch):
    monkeypatch.setattr(L, "LIGHT", 5)
    rows = pa.array([["a"] * n for n in (2, 2, 9, 0, 1)] + [None], pa.list_(pa.string()))
    parts = list(L.light_slices(rows))
    assert sum((p.to_pylist() for p in parts), []) == rows.to_pylist()
    assert all(len(p) == 1 or sum(len(x or ()) for x in p.to_pylist()) <= 5 for p in parts)


def test_the_embedder_hook_hands_on_batches(spark):
    df = spark.range(10, numPartitions=1).selectExpr("id", "cast(id AS string) AS t")
    out = V.embed_batches(df, "t", lambda ts: [[float(t), len(ts)] for t in ts], batch_size=4)
    assert [tuple(r.embedding) for r in out.orderBy("id").collect()] == [(float(i), 4.0 if i < 8 else 2.0) for i in range(10)]
