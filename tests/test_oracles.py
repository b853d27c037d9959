"""Every registered query with an oracle matches DuckDB by value at sf0.001
(the round driver repeats this at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from qalam.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(E.oracle_sql()[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(res.columns, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "final_clean" in df.columns


def test_every_query_has_a_docstring():
    for name, fn in E.queries().items():
        assert fn.__doc__, name
