"""Every registered query of the package."""

from __future__ import annotations

import importlib

from pixelquarry.plans.registry import Registry

MODULES = ["catalog_queries", "metadata_queries", "params_queries", "pixel_queries", "source_queries", "strings_queries", "stats_queries"]

REGISTRY = Registry()
for _name in MODULES:
    _part = importlib.import_module(f"pixelquarry.plans.{_name}").R
    for _key, _fn in _part.queries.items():
        REGISTRY.add(_key)(_fn)
    REGISTRY.oracles.update(_part.oracles)
