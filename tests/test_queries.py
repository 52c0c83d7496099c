"""Registered queries against their SQL in DuckDB on the smallest table sizes."""

import duckdb
import pandas as pd
import pytest

from barlight.plans import queries

SF = "/root/testdata/sf0.01"
QUICK = ["bars_clean", "bars_stored", "tail_metrics", "monitor_transitions", "quality_counts", "quality_gaps", "segments", "features_volume", "split_summary", "decile_spread", "monthly_ic", "position_summary", "holding_runs", "monitor_status"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "events"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    frames = [f[order].sort_values(order).reset_index(drop=True) for f in (got, want)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, rtol=0, atol=2e-8)


def test_every_query_with_columns_has_an_entry():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
