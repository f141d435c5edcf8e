"""Segmentation, phrase replacement, stems and lookups against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import lookup as L
from quire.operators import replace as RP
from quire.operators import rouge as R
from quire.operators import segment as SG
from quire.operators import stem as S


def best_cost(run, lexicon, unknown):
    """Least cost over all cuts, by recursion from the left."""
    best = [0] + [None] * len(run)
    for i in range(len(run)):
        for j in range(i + 1, len(run) + 1):
            c = lexicon.get(run[i:j], unknown if j == i + 1 else None)
            if c is not None and (best[j] is None or best[i] + c < best[j]):
                best[j] = best[i] + c
        best[i + 1] = min(x for x in (best[i + 1], best[i] + unknown) if x is not None)
    return best[-1]


def test_segmentation_is_the_cheapest_path(spark):
    rnd = random.Random(4)
    lexicon = {"".join(rnd.choices("abc法院", k=rnd.randint(1, 4))): rnd.randint(1, 20) for _ in range(60)}
    texts = [["".join(rnd.choices("abc法院é", k=rnd.randint(1, 25))) for _ in range(rnd.randint(0, 6))] for _ in range(40)]
    df = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)] + [(None, None)], "id int, runs array<string>")
    table = spark.createDataFrame(list(lexicon.items()), "word string, cost int")
    out = SG.segment_df(df, "runs", table, "words", 30)
    assert out.columns == ["id", "runs", "words"]
    for r in out.collect():
        if r.runs is None:
            assert r.words in (None, [])
            continue
        assert "".join(r.words) == "".join(r.runs)
        cost = sum(lexicon.get(w, 30) for w in r.words)
        assert cost == sum(best_cost(x, lexicon, 30) for x in r.runs)
    assert SG.segment_df(df.limit(0), "runs", table).collect() == []
    alone = SG.segment_df(df, "runs", table.limit(0), "words", 3).where("id = 3").first()
    assert all(len(w) == 1 for w in alone.words)


def test_longer_words_win_ties_and_long_runs_work(spark):
    table = spark.createDataFrame([("判決", 4), ("判", 2), ("決", 2), ("書", 1)], "word string, cost int")
    df = spark.createDataFrame([(["判決書"],), (["判決書" * 4000],)], "runs array<string>")
    short, long = sorted((r.words for r in SG.segment_df(df, "runs", table).collect()), key=len)
    assert short == ["判決", "書"] and long == short * 4000


def test_unigram_costs(spark):
    df = spark.createDataFrame([(["a"] * 6 + ["bb"] * 2 + ["long"] * 9,)], "t array<string>")
    got = {r.word: r.cost for r in SG.unigram_lexicon(df, "t", 2, 3).collect()}
    assert got == {"a": (17 // 6).bit_length() + 1, "bb": (17 // 2).bit_length() + 1}


@pytest.mark.parametrize("block", [10, 10**6])
def test_leftmost_longest_replacement(spark, block):
    rnd = random.Random(block)
    lexicon = {"".join(rnd.choices("abé台", k=rnd.randint(1, 5))): f"[{i}]" for i in range(40)}
    texts = ["".join(rnd.choices("abcé台 ", k=rnd.randint(0, 60))) for _ in range(60)] + [None, "", "ab" * 30_000]
    table = spark.createDataFrame([*lexicon.items(), ("", "x"), ("zz", None), ("ab", "~~~")], "source string, target string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    lexicon["ab"] = min("~~~", lexicon.get("ab", "~~~"))
    # a regular expression takes the first alternative, hence the longest
    pattern = re.compile("|".join(map(re.escape, sorted(lexicon, key=len, reverse=True))))
    want = {i: None if t is None else pattern.sub(lambda m: lexicon[m[0]], t) for i, t in enumerate(texts)}
    out = RP.replace_phrases(df, "text", table, block_chars=block)
    assert {r.id: r.text for r in out.collect()} == want


def test_replacement_bounds(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    table = spark.createDataFrame([("b" * 50, "x")], "source string, target string")
    with pytest.raises(ValueError):
        RP.replace_phrases(df, "text", table, most_chars=20)
    assert RP.replace_phrases(df, "text", table.limit(0), "out").first().out == "abc"
    many = spark.range(100_000).selectExpr("concat('w', id, 'x') AS source", "concat('<', id, '>') AS target")
    texts = spark.createDataFrame([("w99999x and w5xw51x w123456x",)], "text string")
    assert RP.replace_phrases(texts, "text", many).first().text == "<99999> and <5><51> w123456x"


# published pairs of the algorithm's paper and vocabulary
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil""".split()


def test_published_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    words = spark.createDataFrame([(w,) for w in want], "word string")
    assert {r.word: r.stem for r in S.stemmed(words).collect()} == want
    odd = spark.createDataFrame([("by",), ("is",), ("été",), ("Running",), ("x1ing",), ("",)], "word string")
    assert all(r.word == r.stem for r in S.stemmed(odd).collect())


def test_stems_of_token_arrays(spark):
    rows = [(1, ["running", "dogs", "as", "running"], ["dog", "ran"]), (1, [], None), (2, None, ["cats"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = S.stem_tokens(df, ["a", "b"])
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [(1, ["run", "dog", "as", "run"], ["dog", "ran"]), (1, [], None), (2, None, ["cat"])])
    )


def test_values_of_distinct_words(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["b", "a", "b"]), (2, []), (3, None), (4, ["z"])], "id int, t array<string>")
    table = spark.createDataFrame([("a", 7), ("b", 8), ("q", 9)], "word string, value int")
    rows = L.numbered(df, L.coded(F.col("t")).alias("c"))
    dense = L.values(rows, F.col("c.words"), table, -1)
    assert sorted((r.id, tuple(r["values"])) for r in dense.collect()) == [(1, (8, 7)), (1, (8, 7)), (2, ()), (3, ()), (4, (-1,))]
    found = L.hits(rows, F.col("c.words"), table)
    spread = found.select("id", L.per_token(F.col("hits"), F.col("c.codes"), T.IntegerType()).alias("v"))
    assert sorted((r.id, tuple(r.v)) for r in spread.collect()) == [(1, (8, 7, 8)), (1, (8, 7, 8)), (2, ()), (3, ()), (4, (None,))]
    counts = {r.word: r.df for r in L.document_counts(rows, F.col("c.words")).collect()}
    assert counts == {"a": 2, "b": 2, "z": 1}


def test_references_average_and_best(spark):
    rows = [("c", 0, 0.5, 0.5, 0.5), ("c", 1, 1.0, 0.4, 0.6), ("c", 2, 0.4, 1.0, 0.6), ("d", 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, ref_no int, precision double, recall double, fmeasure double")
    best = {r.k: (r.precision, r.recall, r.fmeasure, r.n_refs) for r in R.reduce_references(df, ["k"], "ref_no", "best").collect()}
    assert best == {"c": (1.0, 0.4, 0.6, 3), "d": (0.0, 0.0, 0.0, 1)}
    mean = {r.k: (round(r.precision, 6), round(r.recall, 6)) for r in R.reduce_references(df, ["k"], "ref_no", "average").collect()}
    assert mean == {"c": (0.633333, 0.633333), "d": (0.0, 0.0)}
    with pytest.raises(ValueError):
        R.reduce_references(df, ["k"], "ref_no", "median")
