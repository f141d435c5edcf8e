"""Plan-shape assertions behind the scale claims in the README."""

import __spark_entry__ as E

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _main_tree(plan: str) -> str:
    """Drop the scalar-subquery trees, printed inline under a ':' rail."""
    keep = []
    for line in plan.split("\n"):
        head = line.split("+-")[0] if "+-" in line else ""
        if ":" not in head:
            keep.append(line)
    return "\n".join(keep)


def _exchanges(plan: str) -> list[str]:
    return [line.strip() for line in plan.split("\n") if "Exchange" in line and "BroadcastExchange" not in line
            and "ReusedExchange" not in line]


def test_encode_ids_joins_distinct_words_only(spark):
    plan = _plan(E.queries()["encode_ids"](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # the distinct words of a row meet the vocabulary and come back: one generator
    assert plan.count("Generate") == 1 and "_coded" in plan


def test_map_combine_stays_inside_the_row(spark):
    plan = _plan(E.queries()["map_combine_summary"](spark, SF_SMALL))
    # weights come back by row number; combining adds no shuffle
    assert all("_row" in x or "word" in x for x in _exchanges(plan))


def test_topk_is_group_limited_and_pair_free(spark):
    plan = _plan(E.queries()["cosine_topk"](spark, SF_SMALL))
    assert "FlatMapCoGroupsInPandas" in plan  # block against block, nothing broadcast
    assert "WindowGroupLimit" in plan  # k per query kept before and after the shuffle
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_rouge_aggregations_follow_the_pair_join(spark):
    plan = _plan(E.queries()["rouge_n"](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert plan.count("Generate") == 1  # n-grams of both sides in one explode


def test_split_uses_no_global_window(spark):
    plan = _plan(E.queries()["split_exact"](spark, SF_SMALL))
    assert "Window" not in plan and "Sort" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(E.queries()["filter_boilerplate"](spark, SF_SMALL))
    assert "StringContains(text,Licensed under the)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,n_chars:bigint>" in plan or "n_chars" in plan


def test_profile_config_is_broadcast(spark):
    plan = _plan(E.queries()["profile_dispatch"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_rouge_counts_are_pre_aggregated(spark):
    plan = _plan(E.queries()["rouge_n"](spark, SF_SMALL))
    assert "partial_sum" in plan
