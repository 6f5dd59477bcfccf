"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cutloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    frame = registry.QUERIES[name](spark, sf)
    rows = frame.collect()
    assert frame.columns and len(set(frame.columns)) == len(frame.columns)
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(frame.columns)
        want = [tuple(plain(row[columns.index(c)]) for c in frame.columns) for row in found.fetchall()]
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
