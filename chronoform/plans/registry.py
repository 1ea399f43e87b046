"""The table of registered queries and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


#: Added before rounding on both sides, so that a value halfway between two results goes one way whatever the order of its sum.
NUDGE = 1e-10


def steady(sql: str) -> str:
    """SQL whose roundings to 6 places match :func:`r6`."""
    out, done = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 6)") and m.start() >= done:
            out += [sql[done : m.start()], f"(round(({sql[m.end() : end - 4]}) + 1e-10, 6) + 0.0)"]
            done = end
    return "".join([*out, sql[done:]])


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = steady(sql)
        return f

    return keep


def r6(column: Column | str) -> Column:
    """Rounded to 6 places, so that sums in another order agree; never minus zero."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(NUDGE), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column rounded by :func:`r6`."""
    return df.select(*[r6(f"`{c}`").alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])
