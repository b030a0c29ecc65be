"""Every core query against its SQL on the smallest data."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from pairaudit.plans import registry

DATA = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns
    df.collect()


def test_flagship(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0
