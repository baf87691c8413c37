"""Every query of the subpackage that has SQL gives the rows of that SQL in another engine; all run."""

import os

import duckdb
import pandas as pd
import pytest

from inkwell.llm import queries


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() >= 0
