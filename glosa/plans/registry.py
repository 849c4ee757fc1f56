"""Collects the named queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is the DuckDB equivalent, if there is one."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sql_list(values) -> str:
    """('a', 'b') for SQL text."""
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_rows(rows) -> str:
    """VALUES body of literal rows."""

    def cell(v):
        return str(v) if isinstance(v, (int, float)) else sql_text(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
