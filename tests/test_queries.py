"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plexum.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(values):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_like_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.sql(registry.ORACLES[name])
    assert names == sorted(found.columns)
    picked = ", ".join(f'"{n}"' for n in names)
    assert rows(map(tuple, df.select(*names).collect())) == rows(duck.sql(f"select {picked} from ({registry.ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
