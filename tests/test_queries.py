"""Each catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from voxelframe import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "events lineitem embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got
    sql = catalogue.oracle_sql().get(name)
    if sql:
        made = duck.execute(sql)
        order = [[c[0] for c in made.description].index(c) for c in columns]
        assert got == sorted(tuple(r[i] for i in order) for r in made.fetchall())


def test_transpositions_shuffle_pieces(spark):
    """Whole pieces of images are shuffled, never a row for each element."""
    for name in ("toseries", "toimages", "toblocks_padded", "blocks_toimages"):
        made = {"toseries": lambda x: x.toseries((3, 3)), "toimages": lambda x: x.toseries().toimages(), "toblocks_padded": lambda x: x.toblocks((3, 5), padding=1), "blocks_toimages": lambda x: x.toblocks((3, 5)).toimages()}[name](catalogue.I(spark, DIR))
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" in plan, name


def test_plans_stay_native(spark):
    """Built-in operators run no Python on the executors, and read only the columns they need."""
    for name in ("center_1", "fourier", "normalize_window_exact", "series_filter", "image_subtract", "max_projection", "crosscorr"):
        plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
        assert "props" not in plan.split("ReadSchema")[-1]


def test_rows_of_ten_with_a_rest(spark, duck, tmp_path):
    """Numbers of records that ten does not divide, and fewer than ten."""
    for n in (23, 20, 7):
        d = str(tmp_path / str(n))
        spark.read.parquet(f"{DIR}/embeddings.parquet").where(f"vec_id < {n}").write.parquet(f"{d}/embeddings.parquet")
        got = sorted(tuple(r) for r in catalogue.queries()["flatten_reshape"](spark, d).collect())
        assert got == [r for r in sorted(duck.execute(catalogue.oracle_sql()["flatten_reshape"]).fetchall()) if 10 * r[0] + r[1] < n] and len(got) == n * 64
