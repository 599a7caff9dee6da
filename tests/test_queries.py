import glob
import os

import duckdb
import pytest

from quillon import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, oracle, name):
    got = queries.queries()[name](spark, DATA)
    want = oracle.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["x"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_assertion_components_agree_with_brute_force(spark, oracle):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, p in oracle.sql("select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem").fetchall():
        a, b = find(s), find(p)
        root[max(a, b)] = min(a, b)
    got = queries.queries()["assertion_components"](spark, DATA).collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in list(root)} and len(got) == len(root)
