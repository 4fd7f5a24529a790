"""Queries of this subpackage that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from folioscope.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(got.columns))
    want = c.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))
