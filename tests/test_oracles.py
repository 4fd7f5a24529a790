"""Every corpus query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from folioscope.plans import queries

NAMES = sorted(queries.oracle_sql())
OTHERS = sorted(set(queries.queries()) - set(NAMES))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return f"{float(v):.6f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", OTHERS)
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    df = queries.flagship(spark, sf_dir)
    counts = {r["family"]: r["count"] for r in df.groupBy("family").count().collect()}
    assert counts["emerging"] == counts["bridge"] >= counts["undercited"] > 0
