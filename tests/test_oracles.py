"""Every registered query of the library against its DuckDB counterpart, and the driver's contract."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from docflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in expected), key=repr)


def test_contract(spark):
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
