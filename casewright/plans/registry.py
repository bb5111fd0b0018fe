"""Names of the library's own queries and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name to callable) and ``ORACLES`` (name to SQL).
MODULES: tuple[str, ...] = ("scalars", "campaign", "selection", "cases", "texts", "stores")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"casewright.plans.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
