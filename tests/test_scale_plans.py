"""Plan regressions for the scale design of the headline queries."""

import pytest

from tenderlake.plans.registry import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["match_tenders", "match_tenders_exact", "filter_cpv_prefix", "competitors"])
def test_top_k_runs_once_and_keys_are_broadcast(spark, name):
    plan = _plan(spark, name)
    assert "MapInArrow" not in plan            # hits were checkpointed once, the plan reads them
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name != "competitors":
        assert "LeftSemi" in plan and "BroadcastExchange" in plan


def test_exact_filtered_match_pushes_release_filters(spark):
    from tenderlake.plans.q_match import FILTER_CASES
    from tenderlake.sources.stored import Views
    import dataclasses
    spec = dataclasses.replace(FILTER_CASES["filter_conjunction"], cpv_prefix=None)
    keys = Views(spark, SF).meta.filter(spec.column()).select("ocid")           # what the match reduces the chunks to
    plan = keys._sc._jvm.PythonSQLUtils.explainString(keys._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(status), IsNotNull(value_amount), EqualTo(status,active)" in plan


def test_listing_is_a_pruned_scan_and_top_n(spark):
    plan = _plan(spark, "list_releases_page")
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(value_amount,100000.0)" in plan and "EqualTo(main_procurement_category,works)" in plan


@pytest.mark.parametrize("name,partial", [("notice_merge", "partial_max_by"),
                                          ("competitor_frequency", "partial_count"),
                                          ("cpv_rollup", "partial_sum"),
                                          ("hash_embed", "partial_count")])
def test_aggregations_are_partial_before_the_shuffle(spark, name, partial):
    plan = _plan(spark, name)
    assert partial in plan and "hashpartitioning" in plan


def test_knn_merge_is_window_group_limited_in_two_levels(spark):
    from tenderlake.operators.knn import top_k_similar
    from tenderlake.sources.stored import Views
    t = Views(spark, SF)
    queries = t.profiles.select("id", "embedding")
    hits = top_k_similar(queries, t.chunks, 10, query_id="id")
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "MapInArrow" in plan and plan.count("WindowGroupLimit") >= 2 and "__salt" in plan and "text#" not in plan


def test_reduce_to_keys_is_sized_in_bytes(spark):
    from tenderlake.operators.joins import reduce_to_keys
    big = spark.range(1000).selectExpr("cast(id as string) as k", "id as v")
    keys = spark.createDataFrame([("1",), ("5",), ("5",), ("zz",)], "k string")
    small = reduce_to_keys(big, keys, "k")
    plan = small._sc._jvm.PythonSQLUtils.explainString(small._jdf.queryExecution(), "formatted")
    assert sorted(r.k for r in small.collect()) == ["1", "5"] and "BroadcastHashJoin" in plan
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = reduce_to_keys(big, keys, "k")
        plan = shuffled._sc._jvm.PythonSQLUtils.explainString(shuffled._jdf.queryExecution(), "formatted")
        assert sorted(r.k for r in shuffled.collect()) == ["1", "5"] and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["filter_conjunction", "search_topk", "match_tenders"])
def test_no_exchange_carries_texts(spark, name):
    plan = _plan(spark, name)
    for block in plan.split("\n\n"):
        if "Exchange\nInput" in block and "Broadcast" not in block:
            assert "text#" not in block, block


def test_award_lot_link_needs_no_shuffle(spark):
    assert "Exchange" not in _plan(spark, "award_lot_link")
