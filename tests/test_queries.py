"""Every inventory query against its SQL on the smallest tables."""

import os

import pytest

from treesync.jobs import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "events", "lineitem")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    out, want = registry.QUERIES[name](spark, DATA), duck.sql(registry.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, out.collect()) == rows(want.columns, want.fetchall())
