"""Every operator as a registered query over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["flagship", "terms", "encoders", "energies", "checks", "generation", "planning",
           "runs", "comparison", "storage", "factored", "making"]


def load():
    """Import all query modules; returns (queries, oracles)."""
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    from catalog.base import ORACLES, QUERIES

    return QUERIES, ORACLES
