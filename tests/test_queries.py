"""Every panel query against its SQL in DuckDB, on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lattica import plans

SLOW = {"fisher_matrix"}


@pytest.fixture(scope="module")
def con(smoke):
    con = duckdb.connect()
    for f in glob.glob(f"{smoke}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    return repr(x + 0.0) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(set(plans.oracle_sql()) - SLOW))
def test_same_as_sql(spark, smoke, con, name):
    got = plans.queries()[name](spark, smoke)
    cur = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = [tuple(plain(row[names.index(c)]) for c in got.columns) for row in cur.fetchall()]
    have = [tuple(plain(x) for x in row) for row in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["subject", "i", "j", "fc"] and rows.count() > 0
