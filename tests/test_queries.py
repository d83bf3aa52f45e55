"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from mentionlake.plans.catalog import QUERIES
from mentionlake.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    got = contract.queries()[name](spark, FOLDER)
    relation = database.sql(contract.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    want = sorted(relation.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
    assert rows == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
