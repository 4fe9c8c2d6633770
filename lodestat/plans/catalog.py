"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

from lodestat.plans.registry import ORACLES, QUERIES

for _name in ("catalog_text", "catalog_stats", "catalog_models"):
    importlib.import_module(f"lodestat.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
