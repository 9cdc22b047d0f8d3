"""Shapes of the physical plans that the scale claims rest on."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from corpuscope.plans.bindings import Tables
from corpuscope.plans.lists import listing
from corpuscope.session import spread

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("a12_duplicate_file_rows", "d01_accessible_documents", "d16_access_decisions", "e05_latest_steps", "f01_bm25_topk", "f03_dense_topk",
          "f06_hybrid_search", "f15_evidence_status", "g10_run_health", "g12_retrieval_metrics", "h03_repeated_actions", "k01_window_limit", "k12_tool_ledger")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert plan(entry.queries()["f01_bm25_topk"](spark, FOLDER)).count("WindowGroupLimit") == 2


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["e05_latest_steps"](spark, FOLDER))
    assert "embedding" not in text and "ReadSchema: struct<event_id:bigint" in text


def test_time_range_reaches_the_scan(spark):
    text = plan(listing.history(Tables(spark, FOLDER).events, "2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_latest_row_combines_before_the_shuffle(spark):
    text = plan(listing.latest_steps(Tables(spark, FOLDER).steps))
    assert "Window" not in text.replace("WindowGroupLimit", "") and "partial_max" in text


def test_spread_leaves_inputs_of_unknown_size_alone(spark):
    small = Tables(spark, FOLDER).documents
    assert "REPARTITION_BY_NUM" in plan(spread(small, "doc_id"))
    huge = spark.range(10**13)
    assert "Exchange" not in plan(spread(huge, "id"))
