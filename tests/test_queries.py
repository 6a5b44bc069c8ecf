"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from vitaloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 8))
    return f"D{v}" if isinstance(v, decimal.Decimal) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


#: Series of one point, of points at one time, microseconds apart, without values or times, of zeros, around zero.
ODD_EVENTS = """VALUES (1, '2024-01-01', 1, 'one', 5.5), (2, '2024-01-05 03:04:05.123456', 2, 'same', 5.5), (3, '2024-01-05 03:04:05.123456', 2, 'same', 7.5), (4, '2024-01-05 03:04:05.123456', 3, 'close', 1),
 (5, '2024-01-05 03:04:05.123457', 3, 'close', 2), (6, '2024-01-05', 4, 'bare', NULL), (7, NULL, 5, 'timeless', 1), (8, NULL, 5, 'timeless', 3), (9, '2024-01-05', 6, 'part', 1), (10, '2024-01-06', 6, 'part', NULL),
 (11, '2024-01-05', 7, 'zero', 0), (12, '2024-01-06', 7, 'zero', 0), (13, '2024-01-05', NULL, NULL, -1), (14, '2024-01-06', NULL, NULL, 1)"""


@pytest.mark.parametrize("name", ["trend_class", "trend_stats"])
def test_odd_series_as_sql(spark, tmp_path, name):
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT i::BIGINT AS event_id, t::TIMESTAMP AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value FROM ({ODD_EVENTS}) AS o(i, t, u, k, v)")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    df, want = catalogue.queries()[name](spark, str(tmp_path)), c.sql(catalogue.oracle_sql()[name])
    assert sorted(tuple(map(plain, r)) for r in df.select(*want.columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["vault_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_semi_join_is_a_hash_join(spark):
    plan = catalogue.queries()["vault_condition_semi_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "NestedLoop" not in plan
