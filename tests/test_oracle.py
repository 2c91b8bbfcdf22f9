"""Registered queries next to their SQL. ``ALL_QUERIES=1`` runs every query, else a cross-section."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "daily_bars",
    "ewm_null_runs",
    "ewm_spread_null_runs",
    "feature_idio_vol_20",
    "feature_vol_ewm_20",
    "feature_momentum_60_sector_rel",
    "flagship_feature_ic",
    "fold_membership",
    "normalize_rank",
    "parse_dates",
    "regime_softmax_weights",
    "ridge_coefficients",
    "ridge_stack_by_regime",
    "shifted_coefficients",
    "store_newest",
    "summarize_models",
    "tabular_ewm",
    "tabular_time_stats",
    "target_encoding",
    "top_weight_share",
    "walk_forward_volatility",
]
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, _, message = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message


@pytest.mark.parametrize("name", ["daily_ic", "normalize_rank", "tabular_ewm", "row_positions", "exact_quantiles"])
def test_split_route_equals_sql(spark, name):
    """Every date, key and type is larger than a task here."""
    spark.conf.set("crosslane.taskRows", "6")
    try:
        ok, _, message = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    finally:
        spark.conf.unset("crosslane.taskRows")
    assert ok, message


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 150
