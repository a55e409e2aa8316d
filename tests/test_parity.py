"""Every query with a SQL twin against DuckDB, at the smallest size."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_has_rows(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0


def test_plans_push_down_and_avoid_products(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    plan = entry.queries()["sa12_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
