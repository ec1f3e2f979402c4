"""Every registered query of the reference's operators against its SQL."""

import datetime
import math
import os

import duckdb
import pytest

from wheelgraph.plans import registry
from wheelgraph.plans.dialect import TABLES

SF = os.environ.get("QUERIES_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=key)
    at = [want.columns.index(n) for n in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b) > 0
    assert a == b


def test_greedy_matching_equals_a_scan(spark):
    from wheelgraph.operators import graph

    pairs = [(i, j, ((i * 7 + j * 13) % 11) / 2) for i in range(9) for j in range(7) if (i + j) % 3]
    want, ui, uj = [], set(), set()
    for d, i, j in sorted((d, i, j) for i, j, d in pairs):
        if i not in ui and j not in uj:
            want.append((i, j, d))
            ui.add(i), uj.add(j)
    got = graph.greedy_match(spark.createDataFrame(pairs, "i long, j long, d double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
