"""Every registered query with a twin equals it on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from asofkit.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(columns, rows):
    """Columns by name, rows by their values; numbers are compared apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(f"{x:.6g}" if isinstance(x, float) else str(x)) for x in r])


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return float(v)
    return [value(x) for x in v] if isinstance(v, (list, tuple)) else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    twin = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    own, expected = canon(df.columns, [tuple(r) for r in df.collect()]), canon(twin.columns, twin.fetchall())
    assert len(own) == len(expected)
    assert [(a, b) for a, b in zip(own, expected, strict=True) if not close(a, b)] == []


def test_entry_and_catalog(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ticker", "date", "score", "rank", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
