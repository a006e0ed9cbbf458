"""Every query of the core catalogue against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int)):
        return int(v)
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_line_items_that_are_there_twice(spark, tmp_path):
    """A result has a row a line item, as its SQL has, though the table repeats one."""
    d = spark.read.parquet(f"{SF}/lineitem.parquet").limit(5)
    d.union(d).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["TX17_float_equal"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["TX17_float_equal"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()) and got.count() == 5


def test_samples_lie_in_many_folders(spark):
    """A file a sample is written by its task, and listed folder by folder."""
    files = catalog.QUERIES["SC08_samples"](spark, SF).inputFiles()
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert len(files) == suppliers and len({os.path.dirname(f) for f in files}) > min(suppliers, 256) // 4
