"""Registered queries, their input views and their DuckDB oracles."""

from __future__ import annotations

import importlib

MODULES = ("graph", "maintenance", "locating", "lookups", "snapshots", "trees", "texts", "streams")


def load():
    """All registered queries and oracles."""
    from codelattice.plans import registry

    for name in MODULES:
        importlib.import_module(f"codelattice.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
