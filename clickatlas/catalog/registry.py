"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL, where there is one."""

    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep
