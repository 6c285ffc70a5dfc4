"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.compare import TABLES, canon

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(TWINS[name])
    want = canon([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["region", "year", "revenue", "line_count"]
    assert out.count() == 10
