"""Query catalogue: modules that hold a registry of queries with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from millrace.registry import Registry, merged


def all_core() -> Registry:
    """Every query of the modules of this package."""
    modules = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    return merged(*(m.registry for m in modules if hasattr(m, "registry")))
