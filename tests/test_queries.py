"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from graphloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for f in os.listdir(DATA):
        d.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return d


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, tmp_path, name):
    got = plans.QUERIES[name](spark, DATA).toArrow()
    if name not in plans.ORACLE_SQL:
        assert got.num_rows > 0
        return
    pq.write_table(got, f"{tmp_path}/got.parquet")
    db.execute(f"CREATE OR REPLACE TABLE want AS {plans.ORACLE_SQL[name]}")
    db.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/got.parquet'")
    cols = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    assert sorted(r[0] for r in db.execute("DESCRIBE want").fetchall()) == sorted(got.column_names)
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
