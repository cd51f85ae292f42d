import os

import duckdb
import pytest

import __spark_entry__
from verstore.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "conversations")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.TABLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda data: sorted(map(repr, data))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(db.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
