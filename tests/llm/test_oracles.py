"""The SQL of the registered queries of the subpackage, on the small tables."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import SF, TABLES, assert_same

from chronoform.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert_same(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df())
