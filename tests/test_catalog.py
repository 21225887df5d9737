"""Every catalogued query with SQL gives what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from threadloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return plain(v.item()) if hasattr(v, "item") else v


def rows(cols, records):
    at = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    want = duck.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, want.fetchall())


def test_entry_points_import():
    import __spark_entry__ as e

    assert "g1_collapse_cutoff" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
