"""The pipeline's rows against its stages' decisions, one by one."""

import corpus_pipeline as cp
from quire.llm import decontaminate, mixing, quality, queries, simhash
from quire.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.test_pii import real


def test_stages_take_effect(spark):
    docs = read(spark, SF_SMALL, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF_SMALL).cache()
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        if name == "quality classifier":
            scored = quality.classify(docs, read(spark, SF_SMALL, "labels"))
            assert ids(kept) == ids(scored.where("predicted = 1"))
        elif name == "SimHash near-dedup":
            groups = simhash.simhash_near_dedup(before).collect()
            assert ids(kept) == sorted({r.component_id for r in groups})
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(before, read(spark, SF_SMALL, "benchmark")).collect()}
            assert bad and ids(kept) == [i for i in ids(before) if i not in bad]
        else:
            old = {r.doc_id: r.text for r in before.collect()}
            for r in kept.collect():
                assert not any(m in r.text for _, m in real(old[r.doc_id])) and r.n_chars == len(r.text)
            assert ids(kept) == ids(before)
    mix = {r.doc_id: r.taken for r in mixing.mix(kept).collect() if r.taken}
    assert {r.doc_id: r.mix_words for r in queries.QUERIES["pipeline"](spark, SF_SMALL).collect()} == mix


def test_odd_tables(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(1, "some text here", "en", "a", 14), (2, None, None, None, None), (2, None, None, None, None), (None, "", "en", "b", 0), (3, "some text here", "en", "a", 14), (4, "Mail a@b.co now please", "en", "b", 22)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_words string")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = cp.run(spark, sf)
    assert got.columns == [*docs.columns, "mix_copies", "_mix_words"]
    assert {r.doc_id for r in got.collect()} <= {1, 4, None} and got.count() >= 1
    docs.limit(0).write.mode("overwrite").parquet(f"{sf}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{sf}/none/{t}.parquet")
    assert cp.run(spark, f"{sf}/none").collect() == []
