"""Registered queries against their SQL on the given tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as registry  # noqa: E402
import compare  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
FAST = (
    "panel_grid",
    "ts_corr",
    "cs_rank",
    "daily_ic",
    "evaluate_factor",
    "multiple_testing",
    "asof_turnover",
    "content_features",
    "formula_checks",
    "symbol_holdout",
    "event_coverage",
    "nearest_neighbors",
    "promotion_gate",
    "finalists",
)
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


def test_registry_is_consistent():
    queries, checks = registry.queries(), registry.oracle_sql()
    assert len(queries) > 140 and set(checks) <= set(queries)


@needs_data
def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].factor_id == "ret_mean_reversal_5d"


@needs_data
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert compare.difference(df, compare.duck(SF_DIR), registry.oracle_sql()[name]) is None
