"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tidewatch.plans import registry

DATA = "/root/testdata/sf0.001"
#: what queries promise to be ordered by
ORDER = {
    "region_hour_features": ["region_name", "datetime_hour"], "region_day_features": ["region_name", "date"], "national_day_features": ["date"], "region_day_metrics": ["region_name", "date"],
    "daily_inequality": ["date"], "region_summary": ["region_name"], "rolling_series": ["region_name", "date"], "timeseries_summary": ["region"], "timeseries_region": ["date"],
    "disruption_series": ["region_name", "date"], "inequality_series": ["date"], "region_list": ["region_name"],
}
TABLES = "region nation customer orders events".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    norm = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = df.collect()
    if name in ORDER:
        keys = [tuple(r[c] for c in ORDER[name]) for r in rows]
        assert keys == sorted(keys)
    assert sorted([tuple(norm(r[c]) for c in columns) for r in rows], key=str) == sorted([tuple(norm(r[i]) for i in at) for r in want.fetchall()], key=str)
