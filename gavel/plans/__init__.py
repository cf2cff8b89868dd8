"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from gavel.plans.registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
