"""Queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookloom.sources.testmarket import P1_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = P1_SQL):
    """Register a query under its function's name; ``sql`` may use the stream that ``base`` defines as p1."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if "p1" in text:
                text = f"with recursive {base}, {text[5:]}" if text.lower().startswith("with ") else f"with {base} {text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return add
