"""Every registered query of the engine against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.database import Database
from eventloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    key = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(key(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_only_queries_with_a_limit_in_sql_have_one(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert ("Limit" in plan) == ("LIMIT" in catalog.ORACLES[name])


def test_documents_of_the_store_are_made_in_many_tasks(spark, monkeypatch):
    """However few row groups the events' file has: here it is one."""
    seen = []
    monkeypatch.setattr(catalog, "_STORES", {})
    monkeypatch.setattr(Database, "write_batch", lambda self, lines: seen.append(lines))
    catalog.stored(spark, DATA)
    assert len(seen) == 2
    for lines in seen:
        assert lines.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
