"""All queries by name, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "matrix_cells"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_found: dict[str, Query] = {}


def query(sql: str | None = None):
    """Registers the decorated function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if f.__name__ in _found:
            raise ValueError(f"query {f.__name__} is there already")
        _found[f.__name__] = Query(f, sql)
        return f

    return add


def _all() -> dict[str, Query]:
    from . import plans  # noqa: F401  registers them

    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in _all().items() if q.sql}
