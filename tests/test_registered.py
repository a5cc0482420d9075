"""Registered queries: contract of the registry and a sample against SQL."""
import pytest

from metrospan.plans import QUERIES

import __spark_entry__ as entry
import oracle

SAMPLE = ["scan_contract", "json_contract", "rule_range", "exactly_one_join", "leakage_audit", "provenance_consumers", "grouped_ols",
          "ols_cluster_robust", "regression_metrics", "pair_ratio", "theory_report", "design_grid", "scenario_status", "group_kfold",
          "cluster_bootstrap", "nested_cv_ridge", "local_equalize", "best_pair", "valid_interior", "table_diff", "manifest"]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values()) and all(s.strip() for s in sql.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "slope" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    problem, n = oracle.compare(oracle.connect(sf), entry.queries()[name](spark, sf), entry.oracle_sql()[name])
    assert problem is None and n > 0


def test_surrogate_rows_are_sampled_and_split_once(spark):
    plan = QUERIES["forest_surrogate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LogicalRDD" in plan  # the prediction reads what the fit read
