"""All registered queries and their checking SQL."""

from __future__ import annotations

import importlib

_MODULES = ["audit", "preparation", "practice", "mitigating", "experiments", "statistics", "stores", "searching", "training"]


def _load(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"evenkeel.bindings.{name}")
        for key, value in getattr(module, attribute).items():
            if key in found:
                raise ValueError(f"query {key!r} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _load("QUERIES")


def oracle_sql() -> dict:
    return _load("SQL")
