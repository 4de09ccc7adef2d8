"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terralapse.plans.queries import ORACLES, QUERIES

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.date):
        return str(value)
    return value


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test data")
@pytest.mark.parametrize("name", ["resample_near", "resample_bilinear"])
def test_resampling_reaches_the_last_row(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{LARGE}/orders.parquet'")
    df = QUERIES[name](spark, LARGE)
    found = con.execute(ORACLES[name])
    assert df.agg({"row": "max"}).first()[0] > 100 and rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["layer", "code", "class_name", "color", "n_cells", "area", "pct"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
