"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from voltaloom.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
