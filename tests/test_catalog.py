"""Every query with SQL gives the SQL's rows at a small size."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from twinpane.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows
    assert plain(tuple(r[n] for n in names) for r in rows) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
