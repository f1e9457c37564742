"""Every registered factor query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factorloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    rows = lambda all_rows: sorted(map(repr, all_rows))
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
