"""Where the query modules enter their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enters a function of (spark, sf_dir) under this name, with DuckDB SQL for the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"there are two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
