"""Every registered image query runs on the smallest tables; those with SQL give the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from pixelloom.plans.queries import SQL, Q

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "part", "nation", "customer", "supplier", "orders", "events", "embeddings"]
NAMES = sorted(Q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = Q[name](spark, SF).toPandas()
    assert len(got)
    if name not in SQL:
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in columns:
        try:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-6, equal_nan=True), c
        except (TypeError, ValueError):
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_source_groups_whole_table(spark, duck):
    rows = duck.sql("select p_partkey, p_retailprice % 100, p_partkey % 97 from part order by 1").fetchall()
    points = [(i, float(x), float(y)) for i, x, y in rows]
    group = {i: i for i, _, _ in points}
    links = [(a, b) for a, ax, ay in points for b, bx, by in points if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != group[b]
            group[a] = group[b] = low
    assert {r.id: r.group_id for r in Q["source_groups"](spark, SF).collect()} == group
