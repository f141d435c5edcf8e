"""Driver contract and plan shape at sf0.001."""

import __spark_entry__ as E

from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(df.columns) == {"lang", "n_docs", "n_chunks", "avg_tokens", "max_tokens"}


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_windows_is_narrow(spark):
    plan = _plan(E.queries()["token_windows"](spark, SF_SMALL))
    # at most the spread of a single-split scan, on the row key; nothing else
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(exchanges) <= 1
    assert all("hashpartitioning(doc_id" in line for line in exchanges)


def test_chunk_profile_plan(spark):
    plan = _plan(E.queries()["chunk_profile"](spark, SF_SMALL))
    # the boilerplate filter reaches the scan, only three columns are read
    assert "StringContains(text,Licensed under the)" in plan
    assert "struct<doc_id:bigint,text:string,lang:string>" in plan
    # one aggregation shuffle (partial + final) plus, at most, the spread
    # of the single-split scan on doc_id
    assert plan.count("partial_count") == 1
    assert plan.count("Exchange") <= 2


def test_small_queries_run(spark):
    q = E.queries()
    for name in ["filter_boilerplate", "clean_text", "rouge_n", "epoch_loss", "cosine_topk", "split_exact"]:
        assert q[name](spark, SF_SMALL).count() >= 1


def test_stream_equals_batch(spark):
    q = E.queries()
    for stream, batch in [("stream_chunks", "token_windows"), ("stream_rolling_summary", "rolling_summary_udf")]:
        a = sorted(map(tuple, q[stream](spark, SF_SMALL).collect()))
        b = sorted(map(tuple, q[batch](spark, SF_SMALL).select(*q[stream](spark, SF_SMALL).columns).collect()))
        assert a == b, stream
