"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quire.plans import contract

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def norm(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, db, name):
    out = contract.queries()[name](spark, DIR)
    cols = sorted(out.columns)
    ours = Counter(repr([norm(r[c]) for c in cols]) for r in out.collect())
    cur = db.execute(contract.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = Counter(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
