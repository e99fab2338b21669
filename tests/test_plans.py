"""Physical plans of the batch queries: nothing that breaks at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import batch_queries, lifecycle_queries, metric_queries, reconcile_queries
from tidemark.sources import adapter as T

MODULES = {m.__name__ for m in (batch_queries, lifecycle_queries, metric_queries, reconcile_queries)}
BATCH = [n for n, f in entry.queries().items() if f.__module__ in MODULES]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_python_or_global_window(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert bad not in plan
    # Everything in one task is only allowed for a global aggregate or a top-n.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert re.search(r"Aggregate\(keys?=\[\]", lines[i - 1]), lines[i - 1]


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(entry.queries()["latency_stats"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_filter_reaches_the_scan(spark, sf):
    rows = T.logins(spark, sf)
    assert "PushedFilters: [In(event_type, [click,error])" in plan_of(rows)


def test_limit_per_group_is_pruned_before_the_shuffle(spark, sf):
    plan = plan_of(entry.queries()["top_event_types"](spark, sf))
    assert "WindowGroupLimit" in plan


def test_conditional_routes_need_no_shuffle(spark, sf):
    for name in ("classification_route", "validate_events", "dlq_classify", "metadata_enrich", "archive_eligible"):
        plan = plan_of(entry.queries()[name](spark, sf))
        assert ("Exchange" in plan) == (name == "metadata_enrich")


def test_small_upsert_does_not_shuffle_the_store(spark, sf):
    from tidemark.operators import reconcile as R
    store = T.sync_copy(spark, sf, "aws")
    changes = T.sync_copy(spark, sf, "azure").where(F.col("aggregateId") == "12")
    merged = R.upsert_latest(store, changes)
    assert len(merged.collect()) == store.count()
    final = plan_of(merged).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def scans(plan):
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("name,most_scans,exchanges", [("status_transition_audit", 1, 1), ("running_tenant_count", 2, None),
                                                       ("idempotent_ingest", 3, None)])
def test_ordered_queries_read_no_more_than_needed(spark, sf, name, most_scans, exchanges):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert scans(plan) <= most_scans
    if exchanges is not None:
        assert len(re.findall(r"\bExchange hashpartitioning", plan)) == exchanges


def test_retry_counts_shuffle_once_before_the_aggregate(spark, sf):
    plan = plan_of(entry.queries()["retry_counts"](spark, sf))
    assert scans(plan) == 1 and len(re.findall(r"\bExchange hashpartitioning", plan)) == 1


def test_a_grant_filter_reads_the_events_once(spark, sf):
    plan = plan_of(entry.queries()["tenant_class_filter"](spark, sf))
    assert len(re.findall(r"FileScan parquet [^\n]*events\.parquet", plan)) == 1
