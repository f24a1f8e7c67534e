"""All queries of the engine's own operators, with the SQL that each must equal.

A query registers under its operator's number and a name; SQL runs in DuckDB on the same tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("text", "detection", "review", "measurement", "structure", "names", "telemetry")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is what it must equal."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"duskveil.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, detect, resolve, label, splice and verify documents."""
    _load()
    return _queries["chain_redact"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small fixture as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql_values(columns: str, rows: list[tuple]) -> str:
    """The same fixture as SQL."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns}))"
