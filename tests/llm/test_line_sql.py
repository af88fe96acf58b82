import os

import duckdb
import pytest

from voxelframe.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, DIR).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
