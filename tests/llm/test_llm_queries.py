from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from pairaudit.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not there")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    got = df.collect()
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)

    def plain(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(str(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i]) for i in order) for r in rows)

    assert plain(got, df.columns) == plain(cur.fetchall(), names)
