"""Every registered query with SQL gives what DuckDB gives on the driver's tables."""

import glob
import os

import duckdb
import pytest

from weftline.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def shown(v):
    return "null" if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        assert ours
        return
    q = duck.execute(ORACLE[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in q.fetchall())
