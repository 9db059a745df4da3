"""Plan shapes: no one-task windows over rows, no cross joins, pushdown and pruning."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tariffspark.operators import metrics, quality
from tariffspark.operators.policy import aggregate_to_policy
from tariffspark.sources import portfolio as S

ROW_LEVEL = ["scan_driver_rows", "policy_aggregate", "policy_to_rows_join", "submission", "segment_kpis", "leakage_watchlist", "price_scalar", "pricing_kpis",
             "target_encoding_oof", "preprocess_fit_transform", "deciles", "double_lift", "ae_by_segment", "bootstrap_ci", "price_grid_search", "split_group_time"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_rows_never_meet_in_one_task(spark, data, name):
    text = plan(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow\b", line):
            assert not any("SinglePartition" in below for below in lines[i + 1:i + 4]), line


def test_policy_aggregation_is_partial_before_its_shuffle(spark, data):
    text = plan(aggregate_to_policy(S.driver_rows(spark, data)))
    assert "partial_count" in text and "partial_max" in text


def test_columns_are_pruned_and_filters_reach_the_scan(spark, data):
    df = S.driver_rows(spark, data).where(F.col("operation_date") >= F.lit("2000-06-01").cast("timestamp_ntz")).select("contract_number", "premium")
    text = df._jdf.queryExecution().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert not any("l_extendedprice" in line or "p_name" in line or "l_comment" in line for line in scans)
    assert any("GreaterThanOrEqual(o_orderdate" in line for line in scans)


def test_validation_counts_in_one_pass(spark, data):
    text = plan(quality.check_null_rates(S.driver_rows(spark, data)))
    assert text.count("lineitem.parquet") == 1


def test_bootstrap_draws_without_copying_rows(spark, policies):
    text = plan(metrics.bootstrap_replicates(policies.withColumn("new_premium", F.col("premium")), "contract_number", 50))
    assert "MapInArrow" in text and "Generate explode" not in text
