"""Every registered query of the document engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from foliospark.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert got


def test_displayed_balances(spark, tmp_path):
    """Balances that round to nothing keep their sign; what is no whole cent, and none."""
    balances = (0.0, -0.0, -0.004, 0.004, 0.005, 1234.565, 1.005, 4.9951, 5.0, 15.0, 9999.99, 123456.5, -999.99, None)
    rows = [(i, f"Customer#{i:09d}", b) for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT c_custkey, money, share, cell FROM ({ORACLE_SQL['display_cells']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["display_cells"](spark, str(tmp_path)).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
