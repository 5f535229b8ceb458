"""Plan checks: no Python UDFs in any registered query, no cartesian
products, filters pushed into the parquet scan, and pruned read schemas."""

import pytest

import __spark_entry__ as E
from stockflow.plans.catalog import load_all
from tests.conftest import SF_SMALL

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(load_all()))
def test_no_python_udf_or_cartesian(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in text, f"{name}: {bad}"


def test_audit_filter_pushed_down(spark):
    text = plan_text(E.queries()["filter_audit"](spark, SF_SMALL))
    assert "PushedFilters" in text


def test_stock_position_prunes_columns(spark):
    text = plan_text(E.queries()["stock_position"](spark, SF_SMALL))
    # lineitem is read for the sales lines only: no price / discount / tax columns
    assert "l_discount" not in text and "l_tax" not in text


def final_plan(df):
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0]


# Exchanges that run, over all scans and joins of the query itself (what it
# stores on its way is read as files).
@pytest.mark.parametrize("name,most", [("ledger_all", 8), ("produce_components_after", 6), ("entity_violations", 24), ("fulfil_ledger", 5)])
def test_exchanges_of_heavy_queries(spark, name, most):
    text = final_plan(E.queries()[name](spark, SF_SMALL))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning") <= most


def test_rules_read_each_table_a_few_times(spark):
    text = final_plan(E.queries()["entity_violations"](spark, SF_SMALL))
    assert text.count("FileScan") <= 70
