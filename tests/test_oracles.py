"""Every registered query against its DuckDB SQL on the smallest tables, values and types."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tilewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{row[k]:.6g}" if isinstance(row[k], float) else str(row[k]) for k in order) for row in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    found = got.collect()
    assert found
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        typed = dict(zip(want.columns, map(str, want.types), strict=True))
        assert {c: kinds[t] for c, t in got.dtypes if t in kinds} == {c: typed[c] for c, t in got.dtypes if t in kinds}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
