"""The registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.tables import GRAPH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph_view: bool = True):
    """Register a query under its function's name, with its SQL; ``graph_view`` puts the graph's views before that."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {GRAPH_SQL}\n{sql}" if graph_view else sql
        return f

    return add


def values(columns: str, rows: str) -> str:
    """SQL of the rows of a text, a row a line, its values apart by bars; ``~`` is null. Columns may have a type: ``line:INTEGER``."""
    names = [c.split(":")[0] for c in columns.split()]
    kinds = [c.partition(":")[2] or "VARCHAR" for c in columns.split()]
    quoted = lambda v: "NULL" if v == "~" else "'" + v.replace("'", "''") + "'"
    lines = [f"({', '.join(quoted(v.strip()) for v in line.split('|'))})" for line in rows.strip().splitlines()]
    casts = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join(lines)}) AS t({', '.join(names)})"
