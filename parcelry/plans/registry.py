"""The registered queries and their SQL."""

from __future__ import annotations

import functools

from ..functions import rounded
from .fixtures import Query, sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name; doubles are rounded to 6 decimals on both sides (R in SQL)."""

    def keep(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark, d):
            return rounded(f(spark, d))

        QUERIES[f.__name__] = run
        if oracle is not None:
            SQL[f.__name__] = sql(oracle)
        return run

    return keep


def R(expression: str, name: str | None = None) -> str:  # noqa: N802
    return f"(round(({expression})::DOUBLE, 6) + 0e0) AS {name or expression.split('.')[-1]}"
