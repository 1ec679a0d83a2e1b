"""The registry behind queries() and oracle_sql()."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, lists: tuple[str, ...] = (), longs: tuple[str, ...] = (), doubles: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL it can be held against.

    So that both give the same types, columns of `lists` are joined to text with commas on either side, and
    the SQL's columns of `longs` and `doubles` are cast.
    """

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists}) if lists else df

        QUERIES[f.__name__] = run
        if sql:
            casts = [f"array_to_string({c}, ',') AS {c}" for c in lists] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs] + [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql.strip()})" if casts else sql
        return f

    return add


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]" if x else "CAST([] AS VARCHAR[])"
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: Iterable[tuple]) -> str:
    """A WITH item that holds the rows."""
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"
