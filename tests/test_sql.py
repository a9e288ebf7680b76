"""Every query that has SQL gives the rows DuckDB gives; every other query runs."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or v != v else int(v) if isinstance(v, bool) else float(v) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        cur = con.execute(registry.SQL[name])
        assert got == norm([c[0] for c in cur.description], cur.fetchall())


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
