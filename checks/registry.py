"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return register


def r(expression: str, digits: int) -> str:
    """SQL for rounding half to even, in double arithmetic throughout."""
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({expression})::DOUBLE * {scale}, 0) / {scale})"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE with constant rows."""

    def literal(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"
