"""Every registered query that has SQL is compared with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import facts, findings, landed, pages, planning, queue, ranks, search, streams, tables, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (search, ranks, pages, text, queue, landed, findings, planning, facts, streams, tables)
NAMES = [(m, k) for m in PLANS for k in m.QUERIES if k in m.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize(("plan", "name"), NAMES, ids=[k for _, k in NAMES])
def test_query_equals_its_sql(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(plan.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert got == want
