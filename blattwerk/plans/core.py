"""The registry of the core's queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package; each has QUERIES (name -> query) and SQL (name -> text).
MODULES = ("searching", "versioning", "screens", "graph", "more", "general")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").SQL
    return found
