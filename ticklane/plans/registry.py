"""Registers queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def near(c: Column | str, digits: int = 6) -> Column:
    """c rounded, off the ties: quotients often end in a 5 at the next digit, where two engines' last bits decide; no negative zero."""
    r = F.round((F.col(c) if isinstance(c, str) else c) + F.lit(0.31 * 10 ** -(digits + 1)), digits)
    return F.when(r == 0, 0.0).otherwise(r)


def near_sql(c: str, digits: int = 6) -> str:
    r = f"round(({c}) + {0.31 * 10 ** -(digits + 1)!r}::DOUBLE, {digits})"
    return f"(CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END)"


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [near(c, digits).alias(n) for n, c in columns.items()]


def rounded_sql(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{near_sql(c, digits)} AS {n}" for n, c in columns.items())
