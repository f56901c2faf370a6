"""The queries that SQL can express, against DuckDB, on the smallest tables and on one with nulls, copies and odd rows."""

import duckdb
import pytest

from tilewright.llm import queries
from tilewright.plans.session import ship


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(row[k]) for k in order) for row in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](ship(spark), sf), con.sql(queries.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op1_distribution_divergence", "op8_positional_index"])
def test_odd_rows(spark, edge, tmp_path, name):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "one two three four"), (None, "12345 67890"), (3, None), (4, ""), (4, "x y z"), (4, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
