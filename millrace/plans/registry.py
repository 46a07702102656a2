"""Collects the named queries and their SQL from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace import plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda i: i.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{info.name}")


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
