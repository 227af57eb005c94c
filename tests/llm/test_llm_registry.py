"""Queries that SQL can express, against DuckDB; all ten and the pipeline are registered."""

import duckdb
import pytest

import __spark_entry__
from doclens.llm import registry


def test_names():
    names = list(__spark_entry__.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
