"""Registered queries against their SQL on the smallest given tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
NAMES = ["W3_rsi", "P17_scores", "A5_A6_P19_rebound_stats", "K2_best_call", "K4_bottom_calls", "J7_T5_settled_checks", "T2_alert_memory",
         "F6_calendar", "S10_P5_nested_chain", "K6_X2_top_contracts"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER).startswith("ok")


def test_entry_and_registry(spark):
    assert entry(spark).columns == ["symbol", "bb_lower", "rsi14", "bb_touch", "rsi_oversold"] and entry(spark).count() == 10
    assert {n for n in queries() if n not in oracle_sql()} <= {n for n in queries() if n == "pipeline" or n[:2] == "op"}
    assert set(oracle_sql()) <= set(queries())
