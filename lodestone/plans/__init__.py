"""Query plans: each module registers named queries and their SQL statements."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for found in pkgutil.iter_modules(__path__):
        yield importlib.import_module(f"{__name__}.{found.name}")


def queries() -> dict:
    """Every registered query by name."""
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracles() -> dict:
    """DuckDB SQL by query name, where SQL can express the query."""
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
