"""Joins of the SimHash groups whose size Spark cannot tell."""

from quire.llm import simhash


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """An explode makes 31 rows of one, but Spark sizes its table like its input."""
    plans, cut = {}, simhash.cut_lineage

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(simhash, "cut_lineage", noted)
    docs = spark.createDataFrame([(i, f"a b c d {i // 2} e f g h") for i in range(40)], "doc_id long, text string")
    out = simhash.simhash_groups(docs)
    last = out._jdf.queryExecution().sparkPlan().toString()
    for plan in (*plans["buckets"], *plans["groups"], last):
        assert "Join" in plan and "BroadcastHashJoin" not in plan
    assert out.count() == 40
