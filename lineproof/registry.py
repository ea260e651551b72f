"""The registered queries: modules of lineproof.plans each hold QUERIES and SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineproof import plans


def _modules() -> list:
    return [importlib.import_module(f"{plans.__name__}.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found |= getattr(module, "QUERIES", {})
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= getattr(module, "SQL", {})
    return found
