"""Plan-shape checks: the scale properties the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF01

SCALE_CHECKED = [
    "a5_outlier_counts_lineitem", "a3_quantiles_lineitem", "a6_iqr_capped_events", "a12_robust_scale_lineitem",
    "a20_a21_ranking_metrics_lineitem", "a22_threshold_sweep_lineitem", "w1_average_rank_lineitem",
    "w5_stratified_folds_lineitem", "e3_rank_blend_lineitem", "e5_weight_search_lineitem",
    "w4_quantile_bin_events", "c3_neighbour_pairs_orders", "p10_p15_crosses_lineitem",
]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SCALE_CHECKED)
def test_no_single_task_window_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF01))
    for line in plan.split("\n"):
        if "Window [" in line:
            # Window [exprs], [partition spec], [order spec]: the partition spec must not be empty
            assert not re.search(r"\], \[\], \[", line), line
        assert "CartesianProduct" not in line and "BroadcastNestedLoopJoin" not in line, line


def test_fitted_stats_are_applied_without_a_join(spark):
    plan = _plan(E.queries()["a12_robust_scale_lineitem"](spark, SF01))
    assert "Join" not in plan and "Subquery" not in plan and "Aggregate" not in plan


def test_composed_fits_do_not_grow_the_plan(spark):
    """cap -> features -> scale -> weight -> bins: each step adds its own
    projection, not the plan of its fit."""
    from riskframe.operators import rank as rk
    from riskframe.operators import stats as st
    from riskframe.plans.common import table
    df = table(spark, SF01, "events").selectExpr("event_id AS row_id", "value", "user_id", "CAST(value > 90 AS INT) AS y")
    nodes = lambda d: len(d._jdf.queryExecution().analyzed().toString().split("\n"))
    sizes = [nodes(df)]
    for step in (lambda d: st.apply_quantile_cap(d, st.fit_quantile_cap(d, ["value"], 0.99), ["value"]),
                 lambda d: d.withColumn("sq", F.col("value") * F.col("value")),
                 lambda d: st.apply_robust_scaler(d, st.fit_robust_scaler(d, ["value", "sq"]), ["value", "sq"]),
                 lambda d: st.zscore(d, "user_id"),
                 lambda d: st.with_class_weight(d, "y", "w"),
                 lambda d: rk.quantile_bin(d, "value", 10)):
        df = step(df)
        sizes.append(nodes(df))
    assert all(b - a <= 2 for a, b in zip(sizes, sizes[1:])), sizes
    assert df.count() == 10000 and df.where("w IS NULL").count() == 0


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["p18_threshold_label_lineitem"](spark, SF01)
    schemas = [m.group(1) for m in re.finditer(r"^ReadSchema: struct<(.*)>$", _formatted(df), re.M)]
    assert schemas
    for s in schemas:
        cols = {c.strip().split(":")[0] for c in s.split(",")}
        assert cols <= {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_extendedprice"}


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
