"""Every registered query of the core against its DuckDB SQL on a small table set."""

import math

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(cell(r[k]) if not isinstance(r[k], bool) else r[k] for k in order)).replace(".0,", ",").replace(".0)", ")") for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
