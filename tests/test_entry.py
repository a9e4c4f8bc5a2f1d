"""The entry point and, on the smallest tables, queries against their DuckDB twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ("s1_daily_panel", "v2_duplicate_keys", "c1_c13_row_ratios", "r5_rsqr", "r13_imax", "f5_idiovol20", "x1_preprocess", "x7_daily_ic", "w1_w3_periods_1d", "g18_cumulative_rank_ic", "w6_w7_rebalance_ledger", "g22_g23_run_manifest", "g14_run_quality", "z6_base_adjusted", "f8_amihud20")


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_twin(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"create view {t.split('.')[0]} as select * from '{small}/{t}'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    twin = con.sql(entry.oracle_sql()[name])
    order = [list(twin.columns).index(c) for c in cols]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in order) for r in twin.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
