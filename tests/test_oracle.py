"""Registered queries against their SQL. PANELCAST_ALL=1 checks every query."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from panelcast.plans import registry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
FAST = [
    "g1_regular_spine", "g10_fixed_windows", "f1_split_rows", "s5_json_daily_last", "j4_asof_keyed_ticks", "j8_fold_range_join", "o2_keep_last",
    "w1_price_and_load_lags", "w8_fill_forward_backward", "w18_cumulative_sum", "c3_holidays", "c10_net_imports", "a3_null_rates_grouping_sets", "a23_mcar_mask",
    "b2_schedule_profit", "t1_tumbling_hourly",
]
NAMES = sorted(registry.ORACLE) if os.environ.get("PANELCAST_ALL") else FAST
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    res = compare(spark, duck(FOLDER), queries()[name], oracle_sql()[name], FOLDER)
    assert res["ok"], res.get("why")


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
