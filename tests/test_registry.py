"""Every registered query of the reference's operators against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from lineproof import registry
from tools.compare import plain

SF = "/root/testdata/sf0.001"
#: Order-dependent or recursive rules that SQL cannot say, or not on whole tables; tests/test_pages.py holds them to brute force.
WITHOUT_SQL = {"u3_group_closure", "w5_grids", "w7_paragraphs", "w16_regions", "j23_related_crops"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert registry.queries().keys() - registry.oracle_sql().keys() == WITHOUT_SQL
    assert registry.oracle_sql().keys() <= registry.queries().keys()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want
