"""All queries of the library with their SQL for DuckDB."""

from __future__ import annotations

import importlib
import pkgutil

import clipfleet.plans as _plans
from clipfleet.plans.base import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(_plans.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"clipfleet.plans.{_m.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
