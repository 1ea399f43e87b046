"""Every registered query with SQL against DuckDB on the small tables; the others must return rows."""

from __future__ import annotations

import importlib.util
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names() -> list[str]:
    from chronoform import plans

    return list(plans.load().QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(columns to be equal as text, columns of numbers to be close), rows in one order."""
    df = df[sorted(df.columns)]
    numbers = [c for c in df if df[c].dtype.kind == "f" or df[c].map(lambda v: isinstance(v, float)).any()]
    exact = df[[c for c in df if c not in numbers]].astype(str)
    close = df[numbers].astype(float)
    order = exact.assign(**{f"~{c}": close[c].round(4) + 0.0 for c in numbers}).fillna(-1e300).sort_values([*exact.columns, *[f"~{c}" for c in numbers]], kind="stable").index
    return exact.loc[order].reset_index(drop=True), close.loc[order].reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for c in got:  # a column of whole numbers with nulls is of floats on one side only
        if {got[c].dtype.kind, want[c].dtype.kind} & {"f"}:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    (a, x), (b, y) = ordered(got), ordered(want)
    assert a.columns.tolist() == b.columns.tolist()
    assert (a.values == b.values).all(), a[(a.values != b.values).any(axis=1)].head()
    assert np.allclose(x, y, rtol=1e-5, atol=2e-6, equal_nan=True), (x[~np.isclose(x, y, rtol=1e-5, atol=2e-6, equal_nan=True).all(axis=1)].head(), y[~np.isclose(x, y, rtol=1e-5, atol=2e-6, equal_nan=True).all(axis=1)].head())


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from chronoform import plans

    registry = plans.load()
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE:
        assert len(got) and got.columns.is_unique
        return
    assert_same(got, duck.sql(registry.ORACLE[name]).df())


def test_entry_and_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
    if importlib.util.find_spec("chronoform.llm"):
        assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))
