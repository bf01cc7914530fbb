"""The plans the design relies on."""

import pytest
from conftest import SETTINGS
from pyspark.sql import functions as F

from eventloom.operators import analytics, quota, tenants
from eventloom.plans import scratch
from eventloom.plans.ingest import accepted_events, outcomes
from eventloom.plans.spread import spread, tasks_for
from eventloom.registry import inputs
from eventloom.sources import store

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def projects(spark):
    return inputs.projects(spark, SF)


@pytest.fixture(scope="module")
def requests(spark):
    return inputs.single_requests(inputs.events_table(spark, SF))


@pytest.fixture(scope="module")
def stored(spark):
    return inputs.stored_events(spark, SF)


def test_ingest_is_jvm_only_and_broadcasts_the_tenants(requests, projects):
    plan = physical(accepted_events(outcomes(requests, projects, SETTINGS)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tenant_lookup_has_another_way_for_many_tenants(spark, requests, projects):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(tenants.resolve_tenants(requests, projects, SETTINGS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scan_reads_only_what_a_query_needs(stored):
    plan = physical(analytics.revenue(stored))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "page_url" not in schema and "event_id" not in schema
    assert "EqualTo(event_type,purchase)" in plan


def test_page_is_a_top_k(stored):
    plan = physical(store.project_page(stored, "00000000-0000-7000-8000-000000000003", 10, 5))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(project_id," in plan


def test_deep_page_is_sorted_on_the_cluster(stored):
    plan = physical(store.project_page(stored, "x", 10, 1_000_000))
    assert "TakeOrderedAndProject" not in plan


def test_point_lookup_is_pushed_down(stored):
    assert "EqualTo(event_id,x)" in physical(store.event_by_id(stored, "x"))


def test_counts_combine_before_the_shuffle(stored):
    plan = physical(stored.groupBy("project_id").agg(F.count("*")))
    assert "partial_count" in plan


def test_quota_join_is_chosen_at_run_time(spark, requests, projects):
    resolved = tenants.resolve_tenants(inputs.metered_requests(inputs.events_table(spark, SF)), projects, SETTINGS)
    judged = quota.fixed_window_quota(quota.with_quota_identity(resolved, SETTINGS), SETTINGS)
    assert "AdaptiveSparkPlan isFinalPlan=false" in physical(judged)  # planning has run nothing
    judged.collect()
    assert "BroadcastHashJoin" in physical(judged)  # by then the cutoffs are known to be few


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide
    narrow = spread(spark.range(0, 1000, 1, 1))
    assert narrow.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scratch_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch.fresh_path(spark, "x").startswith(base)
    assert scratch.fresh_path(spark, "x") != scratch.fresh_path(spark, "x")


def test_tasks_that_parse_are_small_before_the_input_is_large(spark):
    """A task of 100,000 events takes many seconds, more than ten times one of the smallest tables."""
    scan = spark.range(10)
    assert tasks_for(scan, 600_000) >= 30
    assert spread(scan, 600_000).rdd.getNumPartitions() == tasks_for(scan, 600_000)
