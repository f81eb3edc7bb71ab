"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

from loquent.plans import registry

MODULES = ("relational", "aggregates", "functions", "intervals", "text", "folds", "transcript", "streams", "files", "flows", "signals", "extras")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"loquent.plans.{name}_queries")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.SQL)
