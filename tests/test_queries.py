"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "N" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(value, r)) for r in df.select(cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        r = con.execute(sql)
        at = [c[0] for c in r.description]
        assert sorted(at) == cols
        assert sorted(tuple(value(row[at.index(c)]) for c in cols) for row in r.fetchall()) == got


def test_flagship(spark):
    assert registry.flagship(spark, DATA).columns
