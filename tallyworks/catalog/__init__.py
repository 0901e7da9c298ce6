"""Registered queries over the test tables, each with an equivalent SQL statement."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

from . import registry

_MODULES = ("retention", "deviations", "spc", "laboratory", "monitoring", "supply", "primitives")


def registered() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every catalog module."""
    for name in _MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
