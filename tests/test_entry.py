"""Every query against its SQL, as the driver runs them."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_every_query_has_its_sql():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    without_sql = entry.queries().keys() - entry.oracle_sql().keys()
    assert all(name == "pipeline" or name.startswith("op") for name in without_sql)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = ordered([tuple(row[i] for i in order) for row in cursor.fetchall()])
    found = ordered([tuple(row) for row in df.select(columns).collect()])
    assert len(found) == len(expected) > 0
    for a, b in zip(found, expected):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_reviews"] for r in rows) == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    for row in rows:
        assert sum(row[f"n_{s}"] for s in range(1, 6)) <= row["n_reviews"]
