"""Every registered planning query against DuckDB on the same tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from stockweave.plans import catalog as registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Values as the driver compares them: numbers by their exact double, whatever their type."""
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if isinstance(value, (int, float, Decimal)) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, result.fetchall())
